"""Vector codes: every part of a vector becomes the number of its codebook's nearest entry.

Codebooks are fitted by rounds of assigning all parts and moving each entry to its parts' mean. Between rounds a part
keeps, for each group of entries, a lower bound on its distance to the group's entries other than its own, and
the round in which that bound was exact. All codebooks so far are retained, so the bound is lowered by the norm of the
sum of an entry's moves since then (its net displacement) and not by the sum of their norms: an entry that
wanders back costs nothing. A group whose bound stays above the distance to the part's own entry is passed over; the others are
scanned exactly.

Components are integers small enough for squared distances to be exact in doubles. A round reads one table of vectors
with their bounds and writes the next, with each task's sums beside them; the driver receives only sums of
codebook entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.sources.workspace import released, scratch, written

GROUPS = 4
STATE = "vec_id long, label {}, x binary, code binary, bound binary, stamp binary, part int, entry int, sums array<long>"


def bounds_of(n: int, parts: int) -> list[int]:
    return [n * i // parts for i in range(parts + 1)]


def net_moves(books: list[np.ndarray], groups: list[int]) -> np.ndarray:
    """[round, group]: the farthest that an entry of the group has come since the round."""
    now = books[-1].astype(float)
    moved = np.stack([np.sqrt(((now - then) ** 2).sum(1)) for then in books])
    return np.stack([moved[:, a:b].max(1) for a, b in zip(groups, groups[1:])], 1)


class Part:
    """One part position: its codebooks of all rounds so far, as integers, newest last."""

    def __init__(self, books: list[np.ndarray], groups: int):
        self.now = books[-1].astype(float)
        self.norms = (self.now**2).sum(1)
        self.groups = bounds_of(len(self.now), min(groups, len(self.now)))
        self.moves = net_moves(books, self.groups)
        self.round = len(books) - 1
        self.group_of = np.repeat(np.arange(len(self.groups) - 1), np.diff(self.groups))
        self.scanned = 0

    def assign(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> np.ndarray:
        """Squared distance to the nearest entry, ties to the lower one; code, bound and stamp are brought up to date."""
        rows, groups = np.arange(len(x)), range(len(self.groups) - 1)
        own = ((x - self.now[code]) ** 2).sum(1)
        lower = bound - self.moves[stamp, np.arange(bound.shape[1])]
        # The slack covers the rounding of roots; what it lets through is scanned exactly.
        open_ = np.sqrt(own)[:, None] >= lower * (1 - 1e-12) - 1e-6
        best, winner = own.copy(), code.astype(np.int64)
        first, second = np.full(open_.shape, np.inf), np.full(open_.shape, np.inf)
        leader = np.full(open_.shape, -1)
        norms = (x**2).sum(1)
        for g in groups:
            hit = rows[open_[:, g]]
            if not len(hit):
                continue
            a, b = self.groups[g], self.groups[g + 1]
            self.scanned += len(hit) * (b - a)
            d = norms[hit, None] - 2 * (x[hit] @ self.now[a:b].T) + self.norms[a:b]
            at = d.argmin(1)
            least = d[np.arange(len(hit)), at]
            d[np.arange(len(hit)), at] = np.inf
            first[hit, g], second[hit, g], leader[hit, g] = least, d.min(1), a + at
            better = (least < best[hit]) | ((least == best[hit]) & (a + at < winner[hit]))
            best[hit] = np.where(better, least, best[hit])
            winner[hit] = np.where(better, a + at, winner[hit])
        # The entry left behind joins the entries its group's bound stands for.
        left = self.group_of[code]
        moved = (winner != code) & ~open_[rows, left]
        held = np.minimum(lower[rows, left], np.sqrt(own))
        fresh = np.sqrt(np.where(leader == winner[:, None], second, first))
        bound[:] = _under(np.where(open_, fresh, bound))
        stamp[open_] = self.round
        at = rows[moved]
        bound[at, left[at]] = _under(held[at])
        stamp[at, left[at]] = self.round
        code[:] = winner
        return best


def _under(x: np.ndarray) -> np.ndarray:
    """The largest floats of 32 bits that do not exceed x."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def _wide(column: pa.Array, dtype: type, shape: tuple[int, ...]) -> np.ndarray:
    """Rows of a binary column of equal lengths as an array that may be written to."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), *shape).copy()


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize * int(np.prod(x.shape[1:]))
    offsets = pa.py_buffer(np.arange(0, width * len(x) + 1, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x)])


def whole_numbers(embedding: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of one length, kept within the range in which squared distances are exact."""
    most = int((2**51 / max(1, dim)) ** 0.5)
    flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -most, most).astype(np.int32).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of rows whose vector has components, all of them finite."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return own.filter(x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)))


def _round(books: list[np.ndarray], dim: int, parts: int, scale: float, last: bool, label_type: pa.DataType):
    """Task function of one round. Vectors come raw in the first and with their state in later ones."""
    cuts, k = bounds_of(dim, parts), len(books[0])
    groups = min(GROUPS, k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [Part([b[:, cuts[p] : cuts[p + 1]] for b in books], GROUPS) for p in range(parts)]
        sums = np.zeros((k, dim), np.int64)
        counts = np.zeros((parts, k), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if "embedding" in batch.schema.names:
                x = whole_numbers(batch.column("embedding"), dim, scale)
                code = np.zeros((n, parts), np.uint16)
                bound = np.full((n, parts, groups), -1, np.float32)
                stamp = np.zeros((n, parts, groups), np.uint8)
            else:
                x = _wide(batch.column("x"), np.int32, (dim,))
                code = _wide(batch.column("code"), np.uint16, (parts,))
                bound = _wide(batch.column("bound"), np.float32, (parts, groups))
                stamp = _wide(batch.column("stamp"), np.uint8, (parts, groups))
            error = np.zeros(n)
            for p in range(parts):
                own = x[:, cuts[p] : cuts[p + 1]]
                error += of[p].assign(own.astype(float), code[:, p], bound[:, p], stamp[:, p])
                if not last:
                    order = np.argsort(code[:, p], kind="stable")
                    found = np.bincount(code[:, p], minlength=k)
                    used = np.flatnonzero(found)
                    starts = (np.cumsum(found) - found)[used]
                    sums[used, cuts[p] : cuts[p + 1]] += np.add.reduceat(own[order].astype(np.int64), starts, axis=0)
                    counts[p] += found
            kept = [batch.column("vec_id"), batch.column("label")]
            if last:
                columns = [*kept, _packed(code), pa.array(error.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])
            else:
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()))]
                yield _state([*kept, *map(_packed, (x, code, bound, stamp)), *none])
        if not last:
            rows = [
                (p, j, [int(counts[p, j]), *sums[j, cuts[p] : cuts[p + 1]].tolist()])
                for p in range(parts)
                for j in np.flatnonzero(counts[p]).tolist()
            ]
            none = [pa.nulls(len(rows), t) for t in (pa.int64(), label_type, *[pa.binary()] * 4)]
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield _state([*none, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))])

    return run


def _state(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "code", "bound", "stamp", "part", "entry", "sums"])


def _moved(state: DataFrame, book: np.ndarray, parts: int) -> np.ndarray:
    """Entries at the floored means of their parts; entries without any stay. One collected row for each component of an entry."""
    cuts, out = bounds_of(book.shape[1], parts), book.copy()
    rows = state.filter("entry IS NOT NULL").select("part", "entry", F.posexplode("sums").alias("at", "v"))
    sums = {(p, j, at): v for p, j, at, v in rows.groupBy("part", "entry", "at").agg(F.sum("v")).collect()}
    for (p, j, at), v in sums.items():
        if at:
            out[j, cuts[p] + at - 1] = v // sums[p, j, 0]
    return out


def encode_vectors(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0
) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every usable vector, and the final codebooks, entries by components.

    `code` holds two bytes for each part, the lower first; `error` is the squared distance of all parts to their entries.
    A vector that is null or empty, or holds a null or non-finite component, takes no part, nor does one whose length differs from the most
    frequent (the longer of equally frequent ones). Lengths that `parts` does not divide give parts that differ by one.
    Codebooks start as the vectors of the smallest ids, fewer if there are fewer; null ids come last
    and repeated ids in order of their vectors. Repeated rows each get a code. Integers beyond
    sqrt(2^51 / length) are brought back to that bound, so that squared distances stay exact in doubles. Other columns are not read.
    Without any usable vector the result is empty and the codebooks are None.
    """
    spark, good = vectors.sparkSession, usable(vectors)
    label = good.schema["label"].dataType
    ddl = f"vec_id long, label {label.simpleString()}, code binary, error long"
    size = F.size("embedding").alias("n")
    common = good.groupBy(size).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], ddl), None
    dim = common.n
    good = good.filter(F.size("embedding") == dim)
    seeds = good.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    books = [whole_numbers(seeds.column("embedding").combine_chunks(), dim, scale).astype(np.int64)]
    label_type = good.select("label").limit(0).toArrow().schema.field("label").type
    state, path = good, None
    for _ in range(rounds):
        task = _round(books, dim, parts, scale, False, label_type)
        done, path = path, scratch(spark, "codes")
        state.mapInArrow(task, STATE.format(label.simpleString())).write.parquet(path)
        if done:
            released(spark, done)
        table = spark.read.parquet(path)
        books.append(_moved(table, books[-1], parts))
        state = table.filter("entry IS NULL").drop("part", "entry", "sums")
    final = written(state.mapInArrow(_round(books, dim, parts, scale, True, label_type), ddl), "codes")
    if path:
        released(spark, path)
    return final, books[-1]


def with_group_sums(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` over rows of an equal key, nulls together.

    Keys of more than a 256th of all rows, fewer than 256 by that, are shipped to the rows; the others
    are joined by shuffle, where none of them can fill a task.
    """
    sums = written(rows.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_c")), "sums")
    heavy = F.col("_c") * 256 > (sums.agg(F.sum("_c")).first()[0] or 0)
    same = rows[key].eqNullSafe(F.col("_k"))
    hot, cold = (sums.filter(c).select("_k", name) for c in (heavy, ~heavy))
    shipped = rows.join(F.broadcast(hot), same)
    others = rows.join(F.broadcast(hot), same, "left_anti")
    return shipped.drop("_k").unionByName(others.join(cold, others[key].eqNullSafe(F.col("_k"))).drop("_k"))


def book_digest(book: np.ndarray | None, parts: int) -> str:
    """sha256 of all components by part, entry and place."""
    if book is None:
        return sha256(b"").hexdigest()
    cuts = bounds_of(book.shape[1], parts)
    text = ",".join(str(v) for p in range(parts) for row in book[:, cuts[p] : cuts[p + 1]].tolist() for v in row)
    return sha256(text.encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = 4, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256; rows and edge cases as in `encode_vectors`."""
    coded, book = encode_vectors(vectors, parts, 256, rounds, scale)
    digits = [F.hex(F.substring("code", 2 * p + 1, 1)) for p in range(parts)]
    summed = with_group_sums(coded, "label", "error", "label_error")
    return summed.select(
        "vec_id",
        F.lower(F.concat(*digits)).alias("code"),
        "error",
        "label_error",
        F.lit(book_digest(book, parts)).alias("codebooks_sha256"),
    )
