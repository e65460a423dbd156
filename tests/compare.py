"""Run registered queries next to their SQL in DuckDB and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from swathgrid.plans.fixtures import TABLES  # noqa: E402


def session(name="swathgrid-tests", cores=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, str)):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def difference(query, spark, sf_dir, con=None):
    """None if equal, otherwise a short description."""
    df = query.plan(spark, sf_dir)
    rows = df.collect()
    if query.oracle is None:
        return None if rows else "no rows"
    con = con or duck(sf_dir)
    cur = con.execute(query.oracle)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = canonical(df.columns, rows)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if not want:
        return "oracle is empty"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; e.g. {got[:2]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({got_cols}); e.g. {bad[:3]}"
    return None


def main():
    from swathgrid.plans import load

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = session()
    con = duck(sf_dir)
    failures = 0
    for name, q in load().items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            problem = difference(q, spark, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t:6.2f}s {name} {problem or ''}", flush=True)
    print("failures:", failures)


if __name__ == "__main__":
    main()
