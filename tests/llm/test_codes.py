import math
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from helpers import SF

from swathgrid.llm import codes
from swathgrid.llm.codes import Part, compress_vectors, encode_vectors, net_moves
from swathgrid.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x long, part string"


def brute(rows, rounds=4, parts=4, entries=256):
    kept = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    if not kept:
        return []
    sizes = [len(r[1]) for r in kept]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    kept = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0], r[1]))
    ints = [[math.floor(1024 * v) for v in r[1]] for r in kept]
    cut = [dim * i // parts for i in range(parts + 1)]
    code, error, flat = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        xs = [v[cut[p] : cut[p + 1]] for v in ints]
        book = xs[:entries]

        def near(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

        for _ in range(rounds):
            own = [near(x, book)[1] for x in xs]
            book = [
                [sum(col) // len(col) for col in zip(*m, strict=True)] if (m := [x for x, o in zip(xs, own, strict=True) if o == j]) else c
                for j, c in enumerate(book)
            ]
        for i, x in enumerate(xs):
            d, j = near(x, book)
            code[i] += f"{j:02x}"
            error[i] += d
        flat += [v for c in book for v in c]
    digest = sha256(",".join(map(str, flat)).encode()).hexdigest()
    total = {}
    for r, e in zip(kept, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], c, e, total[r[2]], digest) for r, c, e in zip(kept, code, error, strict=True)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def rows_of(rng, n, dim, spread=3.0):
    centres = rng.normal(size=(12, dim)) * spread
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))).astype("f4")
    return [(i, v, int(i % 5) if i % 7 else None) for i, v in enumerate(x.tolist())]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng, 500, 8)
    rows += [(700 + i, rows[3][1], 1) for i in range(250)]  # a third are one vector
    rows += [(3, rows[3][1], 9), (3, rows[8][1], 9), (None, rows[4][1], None)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 8, 1), (1002, [None] * 8, 1), (1003, [], 1), (1004, [1.0] * 5, 1)]
    rows += [(-5, [float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], SCHEMA).repartition(5)
    assert got(compress_vectors(df)) == brute(rows)


@pytest.mark.parametrize("n,dim", [(1, 4), (3, 6), (40, 5), (257, 2)])
def test_small_tables(spark, n, dim):
    rows = rows_of(np.random.default_rng(n), n, dim)
    df = spark.createDataFrame([(*r, "c", 1, "p") for r in rows], SCHEMA)
    assert got(compress_vectors(df)) == brute(rows)


def test_nothing_usable(spark):
    rows = [(1, None, 1, "c", 1, "p"), (2, [float("nan")], 1, "c", 1, "p")]
    for table in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA)):
        assert compress_vectors(table).count() == 0
        assert encode_vectors(table)[1] is None


def test_table_agrees_with_sql(spark):
    plan, sql = QUERIES["op12_codes"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    mine = plan(spark, SF)
    assert got(mine.select(*names)) == sorted(result.fetchall(), key=str)
    assert sorted(mine.columns) == sorted(names)


def test_huge_components_are_held_at_the_bound(spark):
    rows = [(i, [3e38 if i == 1 else float(i), -3e38, 0.0, 1.0], 1, "c", 1, "p") for i in range(6)]
    coded, book = encode_vectors(spark.createDataFrame(rows, SCHEMA))
    assert coded.count() == 6
    assert np.abs(book).max() == int((2**51 / 4) ** 0.5)


def test_net_displacement_is_tighter_than_drifts():
    there, back = np.array([[0, 0]]), np.array([[30, 40]])
    assert net_moves([there, back, there], [0, 1])[:, 0].tolist() == [0.0, 50.0, 0.0]


def test_bounds_stay_below_distances_and_save_scans():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(64, 6)) * 900)[rng.integers(0, 64, 2000)] + rng.normal(size=(2000, 6)) * 60
    x = np.floor(x)
    books = [np.floor(x[:64]).astype(np.int64)]
    code = np.zeros(len(x), np.uint16)
    bound, stamp = np.full((len(x), codes.GROUPS), -1, np.float32), np.zeros((len(x), codes.GROUPS), np.uint8)
    scans = []
    for _ in range(6):
        part = Part(books, codes.GROUPS)
        best = part.assign(x, code, bound, stamp)
        d = ((x[:, None] - books[-1][None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        for g, (a, b) in enumerate(zip(part.groups, part.groups[1:])):
            for i in range(0, len(x), 37):
                others = [np.sqrt(d[i, j]) for j in range(a, b) if j != code[i]]
                assert bound[i, g] - part.moves[stamp[i, g], g] <= min(others) + 1e-3
        scans.append(part.scanned)
        new = [x[code == j].sum(0) // max(1, (code == j).sum()) if (code == j).any() else books[-1][j] for j in range(64)]
        books.append(np.array(new).astype(np.int64))
    assert scans[-1] < scans[0] / 3
