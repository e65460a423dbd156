"""Flat rasters as a sink: tasks stage files, one commit on the driver publishes them all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from swathgrid.sources.binary import locate

COMMITTED = "_COMMITTED"


@dataclass
class _Staged(WriterCommitMessage):
    """Files of a task: folder, part, lines, samples, place in the staging folder."""

    files: list[tuple[str, int, int, int, str]]


class FlatRasterWriter(DataSourceArrowWriter):
    """Rows (row, col, value), and ``channel`` where wanted, to files ``[channel/]part-N.img`` with labels.

    Options: ``path``, ``width``, ``height``, ``rowsPerFile``, ``byteOrder`` (1: big-endian, the default). A task writes
    the parts it holds under names of its own into a staging folder. Only files of tasks that Spark
    accepted are renamed in the commit, so repeated, speculative and failed tasks leave nothing. A part is
    written by one task; :func:`write_rasters` places rows that way. Cells that do not occur are NaN.
    """

    def __init__(self, options, schema, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.width, self.height, self.rows = (int(options[k]) for k in ("width", "height", "rowsPerFile"))
        self.big = int(options.get("byteOrder", 1)) == 1
        self.channels = "channel" in schema.names
        missing = {"row", "col", "value"} - set(schema.names)
        if missing:
            raise ValueError(f"a flat raster needs the columns {sorted(missing)}")
        self.job = f"_staging-{uuid.uuid4().hex}"

    def _base(self) -> tuple[pafs.FileSystem, str]:
        fs, base = locate(self.path)
        return fs, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        fs, base = self._base()
        fs.create_dir(f"{base}/{self.job}", recursive=True)
        done: dict[tuple[str, int], tuple] = {}
        key, data = None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            row, col = (batch.column(c).to_numpy() for c in ("row", "col"))
            if row.min() < 0 or row.max() >= self.height or col.min() < 0 or col.max() >= self.width:
                raise ValueError(f"cells outside of {self.height} x {self.width}")
            value = batch.column("value").to_numpy(zero_copy_only=False)
            channel = batch.column("channel").to_numpy(zero_copy_only=False) if self.channels else np.full(len(row), "")
            part = row // self.rows
            new = np.flatnonzero((part[1:] != part[:-1]) | (channel[1:] != channel[:-1])) + 1
            edges = [0, *new.tolist(), len(row)]
            for a, b in zip(edges, edges[1:]):
                here = (str(channel[a]), int(part[a]))
                if here != key:
                    if key is not None:
                        done[key] = self._stage(fs, base, key, data)
                    if here in done:
                        raise ValueError(f"rows of part {here} are not together")
                    key = here
                    data = np.full((min(self.rows, self.height - here[1] * self.rows), self.width), np.nan, np.float32)
                data[row[a:b] - here[1] * self.rows, col[a:b]] = value[a:b]
        if key is not None:
            done[key] = self._stage(fs, base, key, data)
        return _Staged(list(done.values()))

    def _stage(self, fs, base: str, key: tuple[str, int], data: np.ndarray) -> tuple:
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/{self.job}/{name}") as f:
            f.write(data.astype(">f4" if self.big else "<f4").tobytes())
        return (*key, *data.shape, name)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, base = self._base()
        files = sorted(f for m in messages if m is not None for f in m.files)
        keys = [f[:2] for f in files]
        twice = sorted({k for k, after in zip(keys, keys[1:]) if k == after})
        if twice:
            raise ValueError(f"parts {twice[:3]} were written by more than one task")
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
                if info.path.endswith((".img", ".lbl")) and f"/{self.job}/" not in info.path:
                    fs.delete_file(info.path)
        kind = "IEEE_REAL" if self.big else "PC_REAL"
        for channel, part, lines, samples, name in files:
            folder = f"{base}/{channel}".rstrip("/")
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/part-{part}.lbl") as f:
                f.write(f"LINES = {lines}\nLINE_SAMPLES = {samples}\nSAMPLE_TYPE = {kind}\n".encode())
            fs.move(f"{base}/{self.job}/{name}", f"{folder}/part-{part}.img")
        with fs.open_output_stream(f"{base}/{COMMITTED}") as f:
            f.write(json.dumps({"files": len(files), "lines": sum(f[2] for f in files)}).encode())
        self._clear(fs, base)

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear(*self._base())

    def _clear(self, fs, base: str) -> None:
        if fs.get_file_info(f"{base}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.job}")


def write_rasters(
    cells: DataFrame, path: str, width: int, height: int, rows_per_file: int, mode: str = "append", big_endian: bool = True
) -> None:
    """Cells (row, col, value, and channel if there is one) to flat rasters: one shuffle, each part filled by one task."""
    keys = [c for c in ("channel",) if c in cells.columns]
    part = F.floor(F.col("row") / rows_per_file)
    columns = [*keys, F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("float")]
    placed = cells.select(*columns).repartition(*keys, part).sortWithinPartitions(*keys, "row")
    options = {"width": width, "height": height, "rowsPerFile": rows_per_file, "byteOrder": int(big_endian)}
    placed.write.format("flat_raster").options(**options).mode(mode).save(path)
