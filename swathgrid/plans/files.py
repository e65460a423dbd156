"""Binary files derived from the tables, as input for the scan queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.sources.binary import locate


def write_cubes(pixels: DataFrame, folder: str, bands: list[str], nodata: float = -999.0) -> DataFrame:
    """One cube and header per strip of (strip_id, line, sample, bands...); returns the files.

    A strip is one file and has a fixed number of lines, so a task holds one strip at a time.
    Running a task again writes the same bytes.
    """

    def write(key, table):
        strip = key[0].as_py()
        line, sample = table["line"].to_numpy(), table["sample"].to_numpy()
        lines, samples = int(line.max()) + 1, int(sample.max()) + 1
        cube = np.full((lines, len(bands), samples), nodata, "<f4")
        for i, b in enumerate(bands):
            v = table[b].to_numpy()
            cube[line, i, sample] = np.where(np.isnan(v), nodata, v)
        header = (
            f"ENVI\nsamples = {samples}\nlines   = {lines}\nbands   = {len(bands)}\n"
            "header offset = 0\ndata type = 4\ninterleave = bil\nbyte order = 0\n"
            "band names = {" + ",\n  ".join(bands) + "}\n"
        )
        fs, base = locate(folder)
        fs.create_dir(base, recursive=True)
        for ext, data in (("img", cube.tobytes()), ("hdr", header.encode())):
            with fs.open_output_stream(f"{base}/{strip}.{ext}") as f:
                f.write(data)
        return pa.table({"strip_id": [strip], "img_path": [f"{folder}/{strip}.img"], "length": [cube.nbytes]})

    columns = pixels.select("strip_id", "line", "sample", *[F.col(b).cast("double").alias(b) for b in bands])
    return columns.groupBy("strip_id").applyInArrow(write, "strip_id string, img_path string, length bigint")


def write_flat_rasters(
    cells: DataFrame, folder: str, width: int, rows_per_file: int, big_endian: bool = True
) -> DataFrame:
    """Cells to flat rasters of at most ``rows_per_file`` rows, each with its label."""

    def write(key, table):
        part = key[0].as_py()
        row = table["row"].to_numpy() - part * rows_per_file
        data = np.full((int(row.max()) + 1, width), np.nan, ">f4" if big_endian else "<f4")
        data[row, table["col"].to_numpy()] = table["value"].to_numpy()
        label = (
            f"LINES = {len(data)}\nLINE_SAMPLES = {width}\n"
            f"SAMPLE_TYPE = {'IEEE_REAL' if big_endian else 'PC_REAL'}\n"
        )
        fs, base = locate(folder)
        fs.create_dir(base, recursive=True)
        for ext, body in (("img", data.tobytes()), ("lbl", label.encode())):
            with fs.open_output_stream(f"{base}/part-{part}.{ext}") as f:
                f.write(body)
        return pa.table({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part}.img"]})

    return (
        cells.withColumn("part", F.floor(F.col("row") / rows_per_file).cast("int"))
        .select("part", "row", "col", F.col("value").cast("double").alias("value"))
        .groupBy("part")
        .applyInArrow(write, "part int, path string")
    )
