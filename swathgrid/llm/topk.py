"""Exact top-k inner products by dual-tree search over cover trees.

The first level is distributed. Pivots, chosen farthest-first from a bounded sample, are the top nodes; every vector
belongs to its nearest pivot, and large cells are cut into blocks by id hash. Results are exact
whatever the pivots are. A first pass searches one block of each query's own cell and gives a lower bound of its
kth score. A second pass sends a query only to blocks of cells whose bound reaches it.

Inside a task, queries and vectors of a block have a cover tree each. Pairs of nodes are
dropped when centre product plus covering radii stay under the worst kth score of the query group:
<q, p> <= <cq, cp> + rq |cp| + rp |cq| + rq rp.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swathgrid.sources.workspace import written

NONE = np.iinfo(np.int64).min
LEAF, FANOUT = 128, 32


class CoverTree:
    """Nodes over a permutation of the points: centre, exact covering radius, range, children."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.centre, self.radius, self.begin, self.end, self.children = [], [], [], [], []
        self._node(0, len(points), 0)
        self.points = points[self.order]
        self.centres = points[self.centre]
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.radii = np.array(self.radius)
        self.leaf = np.array([not c for c in self.children])

    def _node(self, begin: int, end: int, centre: int) -> int:
        """centre: a point's own number; nodes of equal points or few points are leaves."""
        own = self.order[begin:end]
        dist = np.sqrt(((self.points[own] - self.points[centre]) ** 2).sum(1))
        node, radius = len(self.centre), float(dist.max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.begin.append(begin)
        self.end.append(end)
        self.children.append([])
        if len(own) <= LEAF or radius == 0:
            return node
        # Farthest-first: centres lie more than half the radius apart, until they cover the rest.
        near, near_dist, centres = np.zeros(len(own), np.int64), dist, [centre]
        while len(centres) < FANOUT and near_dist.max() > radius / 2:
            new = int(own[near_dist.argmax()])
            d = np.sqrt(((self.points[own] - self.points[new]) ** 2).sum(1))
            closer = d < near_dist
            near[closer] = len(centres)
            near_dist = np.where(closer, d, near_dist)
            centres.append(new)
        sort = np.argsort(near, kind="stable")
        self.order[begin:end] = own[sort]
        ends = begin + np.cumsum(np.bincount(near, minlength=len(centres)))
        at = begin
        for c, stop in zip(centres, ends, strict=True):
            if stop > at:
                self.children[node].append(self._node(at, int(stop), c))
            at = int(stop)
        return node


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; float64 is exact under 2 ** 53, Python numbers serve beyond."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    wide = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    limit = np.iinfo(np.int64)
    return np.clip(wide, limit.min + 1, limit.max).astype(np.int64)


@dataclass
class Search:
    """Best k of every query so far, as (score, id) with smaller ids first among equals."""

    q: CoverTree
    p: CoverTree
    q_ids: np.ndarray
    p_ids: np.ndarray
    floor: np.ndarray
    k: int

    def __post_init__(self):
        self.scores = np.full((len(self.q_ids), self.k), NONE)
        self.ids = np.full((len(self.q_ids), self.k), np.iinfo(np.int64).max)

    def bounds(self, node: int, others: np.ndarray) -> np.ndarray:
        q, p = self.q, self.p
        rq, rp = q.radii[node], p.radii[others]
        top = p.centres[others] @ q.centres[node] + rq * p.norms[others] + rp * q.norms[node] + rq * rp
        return top + 1e-9 * np.abs(top) + 1

    def worst(self, node: int) -> int:
        own = slice(self.q.begin[node], self.q.end[node])
        return int(np.maximum(self.scores[own, -1], self.floor[own]).min())

    def open(self, nodes: np.ndarray) -> np.ndarray:
        p = self.p
        return np.array([c for n in nodes for c in (p.children[n] or [n])], np.int64)

    def descend(self, node: int, others: np.ndarray) -> None:
        others = others[self.bounds(node, others) >= self.worst(node)]
        if not len(others):
            return
        if kids := self.q.children[node]:
            others = self.open(others)
            for kid in kids:
                self.descend(kid, others)
            return
        while not self.p.leaf[others].all():
            others = self.open(others)
            others = others[self.bounds(node, others) >= self.worst(node)]
        top = self.bounds(node, others)
        for at in np.argsort(-top):
            if top[at] < self.worst(node):
                break
            self.leaves(node, int(others[at]))

    def leaves(self, node: int, other: int) -> None:
        own, theirs = slice(self.q.begin[node], self.q.end[node]), slice(self.p.begin[other], self.p.end[other])
        score = dots(self.q.points[own], self.p.points[theirs])
        ids = np.broadcast_to(self.p_ids[theirs], score.shape)
        out = (ids == self.q_ids[own, None]) | (score < np.maximum(self.scores[own, -1], self.floor[own])[:, None])
        rows, columns = np.flatnonzero(~out.all(1)), np.flatnonzero(~out.all(0))
        if not len(rows):
            return
        # Only queries and vectors of a pair that counts are merged and sorted.
        some, at = np.ix_(rows, columns), self.q.begin[node] + rows
        score = np.concatenate([self.scores[at], np.where(out[some], NONE, score[some])], axis=1)
        ids = np.concatenate([self.ids[at], np.where(out[some], np.iinfo(np.int64).max, ids[some])], axis=1)
        # ~x reverses integers without overflow.
        sort = np.lexsort((ids, ~score), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(score, sort, 1), np.take_along_axis(ids, sort, 1)


def search_block(queries: pa.Table, points: pa.Table, k: int) -> pa.Table:
    """Best k of each query within a block, only scores that reach the query's floor."""
    names = ["query_id", "vec_id", "score"]
    if not queries.num_rows or not points.num_rows:
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    matrix = lambda t: np.asarray(t["v"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    q, p = CoverTree(matrix(queries)), CoverTree(matrix(points))
    number = lambda t, c, tree: np.asarray(t[c].combine_chunks(), np.int64)[tree.order]
    search = Search(q, p, number(queries, "query_id", q), number(points, "vec_id", p), number(queries, "floor", q), k)
    search.descend(0, np.zeros(1, np.int64))
    real = search.scores > NONE
    ids = np.broadcast_to(search.q_ids[:, None], real.shape)
    return pa.table([pa.array(x[real]) for x in (ids, search.ids, search.scores)], names=names)


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` of the points, each the farthest from those before."""
    chosen, dist = [0], np.sqrt(((sample - sample[0]) ** 2).sum(1))
    while len(chosen) < count and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(1)))
    return sample[chosen]


def integer_vectors(embeddings: DataFrame, scale: float) -> DataFrame:
    """vec_id and v = floor(scale * x) of the rows that take part, exact repeats once."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))
        .dropDuplicates(["vec_id", "v"])
    )


def top_k(
    embeddings: DataFrame,
    every: int = 20,
    k: int = 20,
    scale: float = 64.0,
    cells: int = 64,
    sample: int = 2048,
    block_rows: int = 4096,
    task_queries: int = 50_000,
) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Queries are rows whose vec_id is divisible by `every`, candidates all rows with another id and as many
    components. Components become floor(scale * x); scores are integer inner products, capped to 64
    bits. Equal scores go to the smaller id. Rows with a null id, a null, empty or non-finite
    vector take no part; rows that repeat id and vector count once; of several vectors under one
    id, all are candidates, and the smallest is the query. A query without candidates gives no rows.
    `sample` bounds the rows from which pivots are chosen; every row is indexed.
    """
    spark = embeddings.sparkSession
    vectors = written(integer_vectors(embeddings, scale), "topk-vectors")
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in sorted({len(r["v"]) for r in rows}):
        pivots[dim] = farthest_first(np.array([r["v"] for r in rows if len(r["v"]) == dim], np.float64), cells)
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))

    def place(batches):
        for batch in batches:
            vs = batch.column("v").to_pylist()
            cell, dist = np.zeros(len(vs), np.int64), np.zeros(len(vs))
            for dim in {len(v) for v in vs}:
                at = np.array([i for i, v in enumerate(vs) if len(v) == dim])
                x = np.array([vs[i] for i in at], np.float64)
                # A length that the sample lacks has one cell, around zero.
                c = pivots.get(dim, np.zeros((1, dim)))
                near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
                cell[at] = near + first[dim] if dim in pivots else -dim
                dist[at] = np.sqrt(((x - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(dist)], names=["vec_id", "v", "cell", "dist"]
            )

    placed = written(vectors.mapInArrow(place, "vec_id long, v array<long>, cell long, dist double"), "topk-placed")
    # At most `cells` rows for each length of vectors.
    about = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()}
    blocks = {c: -(-r["n"] // block_rows) for c, r in about.items()}
    sizes = spark.createDataFrame(list(blocks.items()), "cell long, blocks long")
    points = placed.join(F.broadcast(sizes), "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), "vec_id", "v"
    )
    queries = (
        placed.filter(F.col("vec_id") % every == 0)
        .groupBy("vec_id")
        .agg(F.min(F.struct("v", "cell")).alias("row"))
        .select(F.col("vec_id").alias("query_id"), "row.v", "row.cell")
    )
    queries = written(queries, "topk-queries")
    salts = max(1, -(-queries.count() // task_queries))

    def searched(wanted: DataFrame) -> DataFrame:
        """wanted: query_id, v, floor and the cell and block to search. Query groups of a block are salted."""
        left = wanted.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)))
        right = points.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        keys = ["cell", "block", "salt"]
        return (
            left.groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score long")
        )

    home = queries.select("query_id", "v", "cell", F.lit(0).cast("long").alias("block"), F.lit(NONE).alias("floor"))
    seeds = written(searched(home), "topk-seeds")
    known = seeds.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))

    def reach(batches):
        """Blocks that can hold a score as high as the query's floor."""
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            vs, home_cell = batch.column("v").to_pylist(), batch.column("cell").to_pylist()
            floors = batch.column("floor").to_pylist()
            for i, v in enumerate(vs):
                v = np.array(v, np.float64)
                if len(v) in pivots:
                    c, names = pivots[len(v)], range(first[len(v)], first[len(v)] + len(pivots[len(v)]))
                else:
                    c, names = np.zeros((1, len(v))), [-len(v)]
                radii = np.array([about[n]["r"] if n in about else 0.0 for n in names])
                top = c @ v + radii * np.sqrt((v**2).sum())
                top += 1e-9 * np.abs(top) + 1
                for n in np.flatnonzero(top >= floors[i]):
                    cell = names[int(n)]
                    found += [(i, cell, b) for b in range(blocks.get(cell, 0)) if (cell, b) != (home_cell[i], 0)]
            at = pa.array([f[0] for f in found], pa.int64())
            part = batch.select(["query_id", "v", "floor"]).take(at)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array([f[j] for f in found], pa.int64()) for j in (1, 2))],
                names=["query_id", "v", "floor", "cell", "block"],
            )

    wanted = (
        queries.join(known, "query_id", "left")
        .select("query_id", "v", "cell", F.coalesce("floor", F.lit(NONE)).alias("floor"))
        .mapInArrow(reach, "query_id long, v array<long>, floor long, cell long, block long")
    )
    every_find = seeds.unionByName(searched(wanted))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_find.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
