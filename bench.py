"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from swathgrid.plans import load  # noqa: E402

HEADLINE = [
    "mosaic_weighted",
    "strip_daytime",
    "dem_blend",
    "dem_slope",
    "dem_roughness",
    "regrid_bilinear",
    "tile_mosaic_last_valid",
    "zscore",
    "global_stats",
    "range_validation",
    "patch_metadata",
    "channel_stack",
    "zonal_dominant_unit",
    "crater_mask",
    "polygon_raster",
    "blocked_split",
    "crop_sample",
    "catalog_pairing",
    "group_pool",
    "alignment_score",
    "masked_error",
    "classification_metrics",
    "regression_metrics",
    "registration_offsets",
    "envi_cube",
    "stream_mosaic",
]


def session():
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    queries = load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    # Start the Python workers outside the measured time.
    spark.range(8).mapInArrow(lambda it: it, "id long").count()
    seconds = {}
    for name in names:
        t = time.time()
        queries[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
