from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from refscan.llm import selection
from refscan.llm.queries import QUERIES
from tests.conftest import DATA
from tests.oracle import compared, connection

IS_QUERY = "vec_id % 20 = 0"


def brute(vectors, k=20, scale=64):
    """vectors: {vec_id: components}."""
    whole = {i: [int(np.floor(float(x) * scale)) for x in v] for i, v in vectors.items()}
    out = []
    for q in whole:
        if q % 20 == 0:
            scores = sorted(((sum(a * b for a, b in zip(whole[q], v, strict=True)), -i) for i, v in whole.items() if i != q), reverse=True)[:k]
            out += [(q, n + 1, -i, s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def found(df, **more):
    return sorted(map(tuple, selection.top(df, F.expr(IS_QUERY), **more).collect()))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_sql(spark, size):
    assert compared(selection.top(spark.read.parquet(f"{DATA}/{size}/embeddings.parquet"), F.expr(IS_QUERY)), selection.ORACLE, connection(f"{DATA}/{size}")) > 0


def test_blocks_and_ties(spark, monkeypatch):
    """Small blocks, one vector a third of all, scores that are equal in many blocks, and a k beyond the table."""
    monkeypatch.setattr(selection, "VECTORS", 32)
    monkeypatch.setattr(selection, "QUERIES", 8)
    monkeypatch.setattr(selection, "STRIP", 3)
    rng = np.random.default_rng(5)
    kinds = [lambda: [0.25, 0.5, -0.25], lambda: rng.normal(size=3).tolist(), lambda: (rng.integers(-3, 4, 3) / 64).tolist()]
    vectors = {i: kinds[i % 3]() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert found(df) == brute(vectors) and found(df, k=1) == brute(vectors, k=1) and found(df, k=500) == brute(vectors, k=500)


@pytest.mark.parametrize("size", [1e3, 1e6, 1e7])
def test_large_components(spark, size):
    """Scores beyond 24, 53 and 60 bits stay exact."""
    rng = np.random.default_rng(6)
    vectors = {i: (rng.normal(size=8) * size / 10).tolist() for i in range(60)}
    vectors |= {100 + i: vectors[0][:7] + [vectors[0][7] + 1 / 64] for i in range(30)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert found(df) == brute(vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=3).astype(np.float32).tolist() for i in range(30)} | {40: [0.0, 0.0, 0.0]}
    rows = [(i, v, 1) for i, v in vectors.items()] + [(60, None, 1), (80, [1.0, None, 1.0], 1), (100, [1.0, float("nan"), 1.0], 1), (120, [1.0, float("-inf"), 0.0], 1), (140, [1.0], 1), (160, [], 1), (180, [1e30, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0], 1), (20, vectors[20], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    assert found(df) == brute(vectors)
    assert selection.top(df.limit(0), F.expr(IS_QUERY)).count() == 0 and selection.top(df.where("vec_id = 3"), F.expr(IS_QUERY)).count() == 0
    assert selection.top(df.where("vec_id = 0"), F.expr(IS_QUERY)).count() == 0
    assert found(df.where("vec_id < 5")) == brute({i: v for i, v in vectors.items() if i < 5})


def by_contract(rows, k=20):
    """Each row by itself, in whole numbers of any length; vectors of another length have no inner product."""
    fine = [(i, [floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(fine):
        if q % 20 == 0:
            others = [(i, y) for other, (i, y) in enumerate(fine) if other != at and len(y) == len(x)]
            scores = sorted((-min((1 << 63) - 1, max(-(1 << 63), sum(a * b for a, b in zip(x, y, strict=True)))), i) for i, y in others)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def queried(spark, rows, path):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, QUERIES["op11_exact_top_k"](spark, str(path)).select("query_id", "rank", "vec_id", "score").collect()))


def floats(values):
    return [float(x) for x in np.asarray(values, np.float32)]


@pytest.mark.parametrize("size", [3e6, 1e9, 1e14, 1e30])
def test_query_counts_large_vectors(spark, tmp_path, monkeypatch, size):
    """Vectors of any finite size take part, as queries and as candidates, alone and among small ones."""
    monkeypatch.setattr(selection, "VECTORS", 16)
    rng = np.random.default_rng(7)
    rows = [(i, floats(rng.normal(size=8))) for i in range(61)] + [(100 + i, floats(rng.normal(size=8) * size)) for i in range(21)]
    rows += [(200 + i, floats([size * (i % 5)] + [0] * 7)) for i in range(21)] + [(230, floats([0] * 8))]
    assert queried(spark, rows, tmp_path) == by_contract(rows)


def test_query_counts_every_row(spark, tmp_path):
    """Rows that share an id count by themselves; vectors of a rarer length, and empty ones, meet each other."""
    rng = np.random.default_rng(8)
    rows = [(i, floats(rng.normal(size=8))) for i in range(61)]
    rows += [rows[7], rows[7], (7, floats(rng.normal(size=8))), rows[20], (40, floats(rng.normal(size=8)))]
    rows += [(100 + i, floats(rng.normal(size=3))) for i in range(25)] + [(140 + i, []) for i in range(25)] + [(180, None), (181, [float("nan")] * 8), (182, [None] * 8)]
    assert queried(spark, rows, tmp_path) == by_contract(rows)


@pytest.mark.parametrize("bits", [20, 31, 40, 52, 58, 62, 100, 500, 1020])
def test_wide_products(bits):
    """Exact within a long, the nearest long beyond it; sums that cancel are neither lost nor rounded."""
    rng = np.random.default_rng(bits)
    x, y = np.rint(np.ldexp(rng.normal(size=(6, 8)), rng.integers(0, bits, (6, 8)))), np.rint(np.ldexp(rng.normal(size=(8, 40)), rng.integers(0, bits, (8, 40))))
    x[1], y[:, 1] = [2.0**bits, 2.0**bits, 3, 0, 0, 0, 0, 1], [2.0**bits, -(2.0**bits), 5, 0, 0, 0, 0, -1]
    want = [[min((1 << 63) - 1, max(-(1 << 63), sum(int(a) * int(b) for a, b in zip(p, q, strict=True)))) for q in y.T] for p in x]
    got = selection.wide(x, y)
    assert got.dtype == np.int64 and got.tolist() == want and got[1, 1] == 14


def test_blocks_meet_in_many_partitions(spark, monkeypatch):
    """Every block of queries meets every block of vectors if they are spread over partitions, as large tables are."""
    monkeypatch.setattr(selection, "VECTORS", 32)
    monkeypatch.setattr(selection, "QUERIES", 4)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    rng = np.random.default_rng(9)
    vectors = {i: rng.normal(size=3).tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    spark.conf.set(name, "false")
    try:
        assert found(df) == brute(vectors)
    finally:
        spark.conf.set(name, before)
