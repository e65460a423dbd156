"""Binary rasters: flat float rasters with a label, and band-interleaved cubes with a header.

Files are opened through ``pyarrow.fs``, so any path that every executor can reach works. Only
row or line ranges are read, each by its own task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from swathgrid.constants import BIG_ENDIAN_TYPES, ENVI_TYPES, FALLBACK_SHAPES
from swathgrid.functions.geo import wrap_lon
from swathgrid.functions.text import header_int, parse_header, parse_label
from swathgrid.sources.pushdown import Selection, common, joined, without

# Neighbouring bands closer than this are fetched in one read.
GAP_BYTES = 8192
# A Python task costs about 0.1 s before it reads a byte. So beyond this many tasks of a scan each reads more lines than
# asked for, until it has this much.
MANY_TASKS, TASK_BYTES = 512, 4 << 20
# Cells of neighbouring lines that go to Spark in one batch.
BATCH_CELLS = 1 << 16


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _fetch(file, start: int, size: int) -> bytes:
    """All reads of pixel data pass here."""
    file.seek(start)
    return file.read(size)


@dataclass
class Layout:
    """Where the lines of a band-interleaved file lie; a flat raster has one band."""

    name: str
    path: str
    lines: int
    bands: int
    samples: int
    dtype: str
    offset: int = 0

    def sampled(self) -> list[tuple[int, int]]:
        """First, middle and last line."""
        return joined(n for n in (0, self.lines // 2, self.lines - 1) if n >= 0)


@dataclass
class _Part(InputPartition):
    """Stretches of lines of one file or several."""

    runs: list[tuple[Layout, int, int]]


class _LineReader(DataSourceReader):
    """Reads the lines, samples and files that conditions leave, spread over tasks by their number of lines.

    Many small files or small steps make no more than ``MANY_TASKS`` tasks, or as many as have ``TASK_BYTES`` to read.
    Conditions come with the source (option ``where``, see :func:`scan`), or from the query if option ``pushdown`` is true.
    Spark 4.1 keeps what was pushed last for all uses of a loaded DataFrame, also within one plan. So
    ``pushdown`` is for a DataFrame that is used once, with all of its conditions; ``where`` is safe anywhere.
    """

    line, sample = "line", "sample"

    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}
        where = json.loads(self.options.get("where", "{}"))
        self.selection = Selection((self.line, self.sample), ("file",), ("sampled",), where)

    def pushFilters(self, filters):
        asked = self.options.get("pushdown", "false").lower() == "true"
        return self.selection.push(filters) if asked else filters

    def layouts(self) -> Iterator[Layout]:
        raise NotImplementedError

    def step(self, layout: Layout) -> int:
        return int(self.options.get("linespertask", 64))

    def partitions(self):
        stretches = []
        for layout in self.layouts():
            if not self.selection.has_name("file", layout.name):
                continue
            wanted, flags = self.selection.within(self.line, layout.lines), self.selection.flags["sampled"]
            if True not in flags:
                wanted = without(wanted, layout.sampled())
            if False not in flags:
                wanted = common(wanted, layout.sampled())
            stretches += [(layout, first, last) for first, last in (wanted if flags else [])]
        even = -(-sum(last - first for _, first, last in stretches) // MANY_TASKS)
        parts, runs, held = [], [], 0
        for layout, first, last in stretches:
            line_bytes = max(1, layout.samples * layout.bands * np.dtype(layout.dtype).itemsize)
            step = max(self.step(layout), min(even, -(-TASK_BYTES // line_bytes)))
            while first < last:
                stop = min(last, first + max(step - held, 1))
                runs.append((layout, first, stop))
                held, first = held + stop - first, stop
                if held >= step:
                    parts.append(_Part(runs))
                    runs, held = [], 0
        return [*parts, _Part(runs)] if runs or not parts else parts

    def lines_of(self, part: _Part, bands: list[int] | None) -> Iterator[tuple[Layout, int, np.ndarray, np.ndarray]]:
        """(file, line, samples, values by band) of a task."""
        for layout, first, last in part.runs:
            spans = self.selection.within(self.sample, layout.samples)
            if not spans:
                continue
            left, right = spans[0][0], spans[-1][1]
            keep = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in spans])
            rows = read_lines(
                layout.path, first, last, layout.bands, layout.samples, layout.dtype, layout.offset,
                bands or [0], left, right,
            )
            for line, values in enumerate(rows, start=first):
                yield layout, line, keep, values[:, keep - left].astype(np.float32)


def label_fields(text: str) -> dict[str, str]:
    """``KEY = value`` lines of a label, as :func:`parse_label` reads them in columns."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line)
    return {key.strip(): value.strip().strip('"') for key, value in pairs}


def raster_layout(path: str, label: str | None = None) -> Layout:
    """Shape and byte order of a flat raster from its label, if the file has that size, else a known shape."""
    fs, name = locate(path)
    fields = {}
    if label:
        label_fs, label_name = locate(label)
        with label_fs.open_input_stream(label_name) as f:
            fields = label_fields(f.read().decode("utf-8", "ignore"))
    size = fs.get_file_info(name).size
    labelled = [fields.get(k, "").split()[:1] for k in ("LINE_SAMPLES", "LINES")]
    shapes = [tuple(int(v[0]) for v in labelled)] if all(labelled) else []
    fits = [s for s in (*shapes, *FALLBACK_SHAPES) if s[0] * s[1] * 4 == size]
    if not fits:
        raise ValueError(f"{path}: {size} bytes fit no known raster shape")
    kind = fields.get("SAMPLE_TYPE", "").upper()
    order = ">" if "MSB" in kind or kind in BIG_ENDIAN_TYPES else "<"
    return Layout(path.rsplit("/", 1)[-1], path, fits[0][1], 1, fits[0][0], f"{order}f4")


class _FlatRasterReader(_LineReader):
    line, sample = "row", "col"

    def layouts(self) -> Iterator[Layout]:
        """The file itself with its label, or all image files below a folder with theirs."""
        path, label = self.options["path"], self.options.get("label")
        fs, name = locate(path)
        if fs.get_file_info(name).type != pafs.FileType.Directory:
            yield raster_layout(path, label)
            return
        found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
        base = fs.normalize_path(name).rstrip("/") + "/"
        there = {i.path for i in found}
        for image in sorted(p for p in there if p.endswith(".img")):
            short = image.removeprefix(base)
            # Names are tested here, so that labels of files nobody asked for stay shut.
            if "/_" in f"/{short}" or not self.selection.has_name("file", short):
                continue
            label = image[:-4] + ".lbl"
            layout = raster_layout(image, label if label in there else None)
            layout.name = short
            yield layout

    def step(self, layout: Layout) -> int:
        return int(self.options.get("rowspertask", max(1, (32 << 20) // (layout.samples * 4))))

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Layout, int, np.ndarray, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            layouts, rows, cols, values = zip(*held, strict=True)
            v, sizes = np.concatenate([x[0] for x in values]), [len(c) for c in cols]
            names = pa.array([layout.name for layout in layouts]).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
            row = np.repeat(np.array(rows, np.int32), sizes)
            return pa.RecordBatch.from_arrays(
                [names, pa.array(row), pa.array(np.concatenate(cols)), pa.array(v, pa.float32(), mask=~np.isfinite(v))],
                names=["file", "row", "col", "value"],
            )

        cells = 0
        for line in self.lines_of(part, None):
            held.append(line)
            cells += len(line[2])
            if cells >= BATCH_CELLS:
                yield batch()
                held, cells = [], 0
        if held:
            yield batch()


class FlatRaster(DataSource):
    """``spark.read.format('flat_raster').load(path)`` -> file, row, col, value, and the sink of the same name.

    ``path`` is an image file (option ``label`` names its label) or a folder of such files, folders in it included.
    Conditions on ``file``, ``row`` and ``col`` can be answered by reading fewer bytes. For
    very many files build a manifest with :func:`flat_manifest` and use :func:`read_cubes`.
    """

    @classmethod
    def name(cls):
        return "flat_raster"

    def schema(self):
        return "file string, row int, col int, value float"

    def reader(self, schema):
        return _FlatRasterReader(self.options)

    def writer(self, schema, overwrite):
        from swathgrid.sources.writers import FlatRasterWriter

        return FlatRasterWriter(self.options, schema, overwrite)


# ---- cubes ---------------------------------------------------------------------------------


def _runs(bands: list[int], band_bytes: int) -> list[tuple[int, int]]:
    """Selected bands as ranges of neighbouring bands."""
    runs: list[list[int]] = []
    for b in sorted(set(bands)):
        if runs and (b - runs[-1][1] - 1) * band_bytes <= GAP_BYTES:
            runs[-1][1] = b
        else:
            runs.append([b, b])
    return [(a, b) for a, b in runs]


def read_lines(
    path, first, last, n_bands, samples, dtype, offset, bands, left: int = 0, right: int | None = None
) -> Iterator[np.ndarray]:
    """Each line of [first, last) as a (selected bands, samples left to right) array, all else skipped."""
    item = np.dtype(dtype).itemsize
    right = samples if right is None else right
    fs, name = locate(path)
    runs = _runs(bands, samples * item)
    with fs.open_input_file(name) as f:
        for line in range(first, last):
            found = {}
            for a, b in runs:
                size = (b - a) * samples + right - left
                data = _fetch(f, offset + ((line * n_bands + a) * samples + left) * item, size * item)
                block = np.frombuffer(data, dtype)
                found.update({a + i: block[i * samples : i * samples + right - left] for i in range(b - a + 1)})
            yield np.stack([found[b] for b in bands])


def cube_headers(spark: SparkSession, paths: str) -> DataFrame:
    """Header files to a manifest: one row per cube, parsed by Spark and not by the driver."""
    texts = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("hdr_path"), parse_header(F.col("value")).alias("h")
    )
    return texts.select(
        "hdr_path",
        header_int(F.col("h"), "lines").alias("lines"),
        header_int(F.col("h"), "bands").alias("bands"),
        header_int(F.col("h"), "samples").alias("samples"),
        header_int(F.col("h"), "data_type", 4).alias("data_type"),
        header_int(F.col("h"), "byte_order", 0).alias("byte_order"),
        header_int(F.col("h"), "header_offset", 0).alias("header_offset"),
    )


def flat_manifest(spark: SparkSession, labels: str) -> DataFrame:
    """Labels (``*.lbl``) of flat rasters to a manifest of one-band cubes, parsed by Spark.

    As in :func:`raster_layout`, a label's shape counts if the image has that size, else a known shape does. An image that fits
    none, or is not there, ends the job.
    """
    texts = spark.read.text(labels, wholetext=True).select(
        F.col("_metadata.file_path").alias("lbl_path"), parse_label(F.col("value")).alias("h")
    )
    images = spark.read.format("binaryFile").load(re.sub(r"\.lbl$", ".img", labels))  # contents are not read
    sizes = images.select(F.col("_metadata.file_path").alias("img_path"), F.col("_metadata.file_size").alias("size"))
    kind = F.upper(F.coalesce(F.col("h")["SAMPLE_TYPE"], F.lit("PC_REAL")))
    big = kind.contains("MSB") | kind.isin(*BIG_ENDIAN_TYPES)
    first = lambda key: F.regexp_extract(F.col("h")[key], r"^\s*(\d+)", 1).try_cast("int")
    known = [F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in FALLBACK_SHAPES]
    shapes = F.array(F.struct(first("LINE_SAMPLES").alias("w"), first("LINES").alias("h")), *known)
    fits = F.get(F.filter(shapes, lambda s: s["w"].cast("long") * s["h"] * 4 == F.col("size")), F.lit(0))
    misfit = F.raise_error(F.concat("img_path", F.lit(" fits no known raster shape")))
    found = texts.withColumn("img_path", F.regexp_replace("lbl_path", r"\.lbl$", ".img")).join(sizes, "img_path", "left")
    found = found.withColumn("shape", F.when(fits.isNotNull(), fits).otherwise(misfit))
    return found.select(
        F.regexp_extract("lbl_path", r"([^/]+)\.lbl$", 1).alias("strip_id"),
        "img_path",
        F.col("shape.h").alias("lines"),
        F.lit(1).alias("bands"),
        F.col("shape.w").alias("samples"),
        F.lit(4).alias("data_type"),
        big.cast("int").alias("byte_order"),
        F.lit(0).alias("header_offset"),
    )


def item_bytes(data_type):
    """Bytes per element as a column; unknown codes are 4-byte floats."""
    sizes = F.create_map(
        *[F.lit(v) for code, t in ENVI_TYPES.items() for v in (code, np.dtype(t).itemsize)]
    )
    return F.coalesce(sizes[data_type], F.lit(4))


def read_cubes(manifest: DataFrame, bands: dict[str, int], lines_per_task: int = 64) -> DataFrame:
    """Pixels of many cubes: (strip_id, line, sample, one float column per selected band).

    ``manifest``: strip_id, img_path and the header fields. Line ranges of all cubes are spread
    over the cluster, so a single large cube is read by many tasks. A column ``wanted`` (array of lines, as of
    :func:`with_sampled_lines`) leaves all other lines unread.
    """
    names, numbers = list(bands), list(bands.values())
    if "wanted" in manifest.columns:
        chunks = manifest.withColumn("first", F.explode("wanted")).withColumn("last", F.col("first") + 1)
    else:
        starts = F.sequence(F.lit(0), F.col("lines") - 1, F.lit(lines_per_task))
        chunks = manifest.withColumn("first", F.explode(starts))
        chunks = chunks.withColumn("last", F.least(F.col("first") + lines_per_task, F.col("lines")))
    chunks = chunks.select(
        "strip_id", "img_path", "first", "last", "bands", "samples", "data_type", "byte_order", "header_offset"
    ).repartition("img_path", "first")

    def read(batches):
        for batch in batches:
            for job in batch.to_pylist():
                order = ">" if job["byte_order"] == 1 else "<"
                dtype = order + ENVI_TYPES.get(job["data_type"], "f4")
                samples = job["samples"]
                rows = read_lines(
                    job["img_path"], job["first"], job["last"], job["bands"], samples, dtype,
                    job["header_offset"], numbers,
                )
                values = np.stack(list(rows), axis=1).astype(np.float32)
                lines = values.shape[1]
                line = np.repeat(np.arange(job["first"], job["last"], dtype=np.int32), samples)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([job["strip_id"]] * (lines * samples), pa.string()),
                        pa.array(line),
                        pa.array(np.tile(np.arange(samples, dtype=np.int32), lines)),
                        *[pa.array(v.ravel(), pa.float32(), mask=~np.isfinite(v.ravel())) for v in values],
                    ],
                    names=["strip_id", "line", "sample", *names],
                )

    schema = "strip_id string, line int, sample int, " + ", ".join(f"`{n}` float" for n in names)
    return chunks.mapInArrow(read, schema)


def with_sampled_lines(manifest: DataFrame) -> DataFrame:
    """A manifest that asks for the first, middle and last line of each cube only."""
    n = F.col("lines")
    return manifest.withColumn("wanted", F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1)))


def read_locations(manifest: DataFrame) -> DataFrame:
    """Position cubes: band 0 is longitude (wrapped to +-180), band 1 latitude."""
    return read_cubes(manifest, {"lon": 0, "lat": 1}).withColumn("lon", wrap_lon(F.col("lon")))


def read_geometry(manifest: DataFrame) -> DataFrame:
    """Angle cubes: band 1 incidence, band 3 emission, band 4 phase."""
    return read_cubes(manifest, {"incidence": 1, "emission": 3, "phase": 4})


class _CubeReader(_LineReader):
    def __init__(self, options):
        super().__init__(options)
        self.selected = [int(b) for b in self.options["select"].split(",")]

    def layouts(self) -> Iterator[Layout]:
        """Cubes of a stored manifest, or the one that the options describe."""
        o = self.options
        if "manifest" in o:
            fs, name = locate(o["manifest"])
            columns = ["strip_id", "img_path", "lines", "bands", "samples", "data_type", "byte_order", "header_offset"]
            rows = pq.read_table(name, columns=columns, filesystem=fs).sort_by("strip_id").to_pylist()
        else:
            fields = {"data_type": "datatype", "byte_order": "byteorder", "header_offset": "headeroffset"}
            rows = [{k: int(o[k]) for k in ("lines", "bands", "samples")} | {k: int(o[v]) for k, v in fields.items() if v in o}]
            rows[0] |= {"strip_id": o["path"].rsplit("/", 1)[-1], "img_path": o["path"]}
        for row in rows:
            dtype = (">" if row.get("byte_order") == 1 else "<") + ENVI_TYPES.get(row.get("data_type", 4), "f4")
            shape = row["lines"], row["bands"], row["samples"]
            yield Layout(row["strip_id"], row["img_path"], *shape, dtype, row.get("header_offset") or 0)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        for layout, line, samples, values in self.lines_of(part, self.selected):
            flat = values.T.ravel()
            offsets = np.arange(0, flat.size + 1, len(self.selected), dtype=np.int32)
            known = any(a <= line < b for a, b in layout.sampled())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([layout.name] * len(samples)),
                    pa.array(np.full(len(samples), line, np.int32)),
                    pa.array(samples),
                    pa.array(np.full(len(samples), known)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float32(), mask=~np.isfinite(flat))),
                ],
                names=["file", "line", "sample", "sampled", "bands"],
            )


class BilCube(DataSource):
    """``spark.read.format('envi_bil')`` for one cube, or for all cubes of a stored manifest (option ``manifest``).

    Option ``select`` lists the wanted bands. ``sampled`` tells the first, middle and last line of a cube. Conditions on ``file``
    (strip_id of a manifest), ``line``, ``sample`` and ``sampled`` can be answered by reading fewer bytes.
    """

    @classmethod
    def name(cls):
        return "envi_bil"

    def schema(self):
        return "file string, line int, sample int, sampled boolean, bands array<float>"

    def reader(self, schema):
        return _CubeReader(self.options)


def scan(spark: SparkSession, kind: str, where: dict, **options) -> DataFrame:
    """Load a source of this module with conditions of its own.

    >>> scan(spark, "envi_bil", {"line": [(0, 8)], "file": ["a", "b"], "sampled": True}, manifest=path, select="2")
    """
    return spark.read.format(kind).options(where=json.dumps(where), **options).load()


def register(spark: SparkSession) -> None:
    """Make the data sources known, and let Spark offer them its conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FlatRaster)
    spark.dataSource.register(BilCube)
