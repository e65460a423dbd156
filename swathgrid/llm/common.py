"""Column expressions and small task helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathgrid.sources.workspace import released, scratch, write

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run without ASCII white space. `bytes.split()` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Drafts:
    """Tables that an operator writes on its way and drops when the tables that follow from them are written."""

    def __init__(self) -> None:
        self.held: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
        path = scratch(df.sparkSession, name)
        write(df, path, partition_by)
        self.held.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop_part(self, place: int, part: str) -> None:
        """Drop the rows of one folder of a table that is written by parts; the table must be read by other parts only."""
        spark, path = self.held[place]
        released(spark, f"{path}/{part}")

    def drop(self, but_last: bool = False) -> None:
        last = self.held[-1:] if but_last else []
        for own in self.held[: len(self.held) - len(last)]:
            released(*own)
        self.held = last


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that count, whatever else the table holds; null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def words(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int, most_rows: int = 32768) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about `most_bytes` of `column`, `most_rows` rows at most and one at least."""
    for batch in batches:
        sizes = [len(x) if x else 0 for x in map(lambda v: v.as_buffer(), batch.column(column))]
        start = held = 0
        for i, size in enumerate(sizes):
            if (held + size > most_bytes and i > start) or i - start == most_rows:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def joined(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a row of entries, each given by its place among those that `flat` holds in order; and where each ends."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n) + np.arange(n.sum())], np.append(0, ends)
