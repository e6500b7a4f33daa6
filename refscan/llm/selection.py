"""Exact top-k search by distributed selection on histograms of scores.

Vectors are turned into whole numbers, so scores are exact. Each query's k-th score is located first: all
scores are counted in histograms, block by block, and the histograms of a query's blocks are summed; the bin that holds the
k-th is the next interval, until a bin is one value. Then all scores are compared with that value: what lies above is in the
result, of what equals it the smallest ids fill the rest. Scores are never stored, and no block decides by itself.
Of a block's histogram the bins below its own k-th best can't hold the k-th of all: they aren't sent.

Queries and vectors meet in blocks of bounded size, as matrix products; what grows with the square of the table is their work alone.
Products are taken in the narrowest type in which a block's sums are exact; beyond that modulo 2**64, with a rough sum that says which values a long can't hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import temporary, written

SCALE = 64
#: Bins of a histogram are two to the power of BITS.
BITS = 8
#: Queries and vectors of a block, in expectation, and queries whose scores are held at a time.
QUERIES, VECTORS, STRIP = 1024, 4096, 128
#: Scores beyond a long are given as the nearest long.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE, as_given: bool = False) -> DataFrame:
    """vec_id, v (whole numbers, as doubles: no digit is lost): one row for each id or, ``as_given``, for each row; see ``top`` for what takes no part."""
    # A double from 2**53 on is whole.
    component = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**53, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    known = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    most = float("inf") if as_given else 2.0**63
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < most))
    whole = known.where(fine).select("vec_id", component.alias("v"))
    return whole if as_given else whole.groupBy("vec_id").agg(F.min("v").alias("v"))


def dealt(blocks: str) -> Column:
    """The block of a row, of so many: an int, as in the other side's keys (an equal bigint has another hash, so it would be in another partition)."""
    return F.pmod(F.xxhash64("row"), F.col(blocks)).cast("int")


def matrix(block: pa.Table, column: str) -> np.ndarray:
    found = block[column].combine_chunks()
    flat = found.values.to_numpy(zero_copy_only=False)[found.offsets[0].as_py() : found.offsets[-1].as_py()]
    return flat.reshape(len(block), len(flat) // max(1, len(block)))


def wrapped(x: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64, as longs."""
    rest = np.fmod(x.astype(np.float64), 2.0**64)  # exact, and so are the sums
    return (rest - 2.0**64 * (rest >= 2.0**63) + 2.0**64 * (rest < -(2.0**63))).astype(np.int64)


def wide(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y of whole numbers of any size, to the nearest long.

    Longs give the value modulo 2**64; a sum of doubles says which multiple is missing. Where its error may be too large for
    that, and for saying that a long can't hold the value, whole numbers of any length decide."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        rest, rough = wrapped(x) @ wrapped(y), x @ y
        room = len(y) * 2.0**-50 * (np.abs(x) @ np.abs(y)) + 2.0**12  # over the error of rough, and of what is computed from it
        turns = np.rint((rough - rest) / 2.0**64)
        sure = room < 2.0**62
        above, below = np.where(sure, turns > 0, rough - room > 2.0**64), np.where(sure, turns < 0, rough + room < -(2.0**64))
    score = np.where(above, HIGHEST, np.where(below, LOWEST, rest))
    for i, j in zip(*np.nonzero(~(sure | above | below)), strict=True):
        score[i, j] = min(HIGHEST, max(LOWEST, sum(int(a) * int(b) for a, b in zip(x[i], y[:, j], strict=True))))
    return score


def strips(q: dict[str, np.ndarray], rows: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Scores of some queries at a time with all vectors of a block: which, the scores, and which of them count (a row isn't its own candidate)."""
    x = q["v"]
    largest = lambda v: max(1.0, float(np.abs(v.astype(np.float64)).max(initial=0)))
    bound = largest(x) * largest(y) * y.shape[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else None  # in which all sums are exact
    y = y.astype(kind or np.float64).T.copy()
    order = np.argsort(rows)
    at = order[np.minimum(np.searchsorted(rows, q["row"], sorter=order), len(rows) - 1)]
    own = rows[at] == q["row"]
    for begin in range(0, len(x), STRIP):
        part = slice(begin, min(begin + STRIP, len(x)))
        score = (x[part].astype(kind) @ y).astype(np.int64) if kind else wide(x[part], y)
        counts = np.ones(score.shape, bool)
        counts[np.flatnonzero(own[part]), at[part][own[part]]] = False
        yield part, score, counts


def unpacked(q: pa.Table, c: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]] | None:
    """Of a block of each side, one row each: columns of the queries and of the vectors."""
    if not q.num_rows or not c.num_rows:
        return None

    def columns(side: pa.Table) -> dict[str, np.ndarray]:
        kind = side.schema.field("rows").type.value_type
        rows = pa.table(side["rows"].combine_chunks().flatten().flatten(), names=[kind.field(n).name for n in range(kind.num_fields)])
        return {k: rows[k].to_numpy() for k in rows.column_names if k != "v"} | {"v": matrix(rows, "v")}

    return columns(q), columns(c)


COUNTS = pa.schema([("row", pa.int64()), ("bin", pa.int32()), ("n", pa.int64())])
FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def histograms(q: pa.Table, c: pa.Table) -> pa.Table:
    """For each query, how many of the block's scores are in each bin of its interval, down to the bin of the block's own k-th."""
    if (both := unpacked(q, c)) is None:
        return COUNTS.empty_table()
    queries, vectors = both
    out = []
    for part, score, counts in strips(queries, vectors["row"], vectors["v"]):
        lo, shift = queries["lo"][part], queries["shift"][part]
        counts &= (score >= lo[:, None]) & (score <= queries["hi"][part, None])
        row, at = np.nonzero(counts)
        bins = (score[row, at] >> shift[row]) - (lo >> shift)[row]
        n = np.bincount((row << BITS) + bins, minlength=len(score) << BITS).reshape(len(score), -1)
        above = n[:, ::-1].cumsum(1)[:, ::-1] - n
        row, at = np.nonzero((n > 0) & (above < queries["need"][part, None]))
        out.append(pa.Table.from_arrays([pa.array(queries["row"][part][row]), pa.array(at.astype(np.int32)), pa.array(n[row, at])], schema=COUNTS))
    return pa.concat_tables(out)


def selected(q: pa.Table, c: pa.Table) -> pa.Table:
    """Scores above each query's k-th, and of those equal to it as many as may be needed, by id."""
    if (both := unpacked(q, c)) is None:
        return FOUND.empty_table()
    queries, vectors = both
    out = []
    for part, score, counts in strips(queries, vectors["row"], vectors["v"]):
        kth = queries["lo"][part, None]
        row, at = np.nonzero(counts & (score > kth))
        tie_row, tie = np.nonzero(counts & (score == kth))  # a row's places ascend, and so do their ids
        first = np.arange(len(tie_row)) - np.searchsorted(tie_row, tie_row) < queries["need"][part][tie_row]
        row, at = np.concatenate([row, tie_row[first]]), np.concatenate([at, tie[first]])
        out.append(pa.Table.from_arrays([pa.array(queries["row"][part][row]), pa.array(queries["query_id"][part][row]), pa.array(vectors["vec_id"][at]), pa.array(score[row, at])], schema=FOUND))
    return pa.concat_tables(out)


def met(queries: DataFrame, blocks: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies a function to each block of queries (with the state of their search) with each block of vectors of their length."""
    row = F.struct("row", "query_id", "v", "lo", "hi", "shift", "need")
    packed = queries.groupBy("size", "i", "vector_blocks").agg(F.collect_list(row).alias("rows"))  # no more than a block holds
    left = packed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("vector_blocks") - 1))).drop("vector_blocks")
    right = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).drop("query_blocks")
    return left.groupBy("size", "i", "j").cogroup(right.groupBy("size", "i", "j")).applyInArrow(function, schema)


def top(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, as_given: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the largest score (all, if fewer) for each row where ``is_query`` (of vec_id) holds.

    A score is the inner product of floor(scale * component), in whole numbers; candidates are all rows of the query's
    length but its own; ties go to the smaller vec_id. Vectors that are null, or hold null or non-finite components, take
    no part, neither do null ids. Of rows with one id the smallest vector counts, and vectors with whole numbers beyond
    a long take no part; ``as_given`` every row counts by itself (a query for each row, and rows that share its id are
    candidates) and so does every finite vector. Scores beyond a long are given as the nearest long, and rank as equal.
    Equal vectors are candidates like others, however many they are. Without queries, or with an empty table, the
    result is empty; other columns are ignored."""
    spark = vectors.sparkSession
    with temporary(spark):
        every = written(quantised(vectors, scale, as_given).withColumn("row", F.monotonically_increasing_id()), "whole-numbers")
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        longest, largest = every.agg(F.max(norm("v")), F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x))))).first()
        if longest is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        whole = F.transform("v", lambda x: x.cast("int")) if largest < 2.0**31 else F.col("v")  # half the bytes for most tables
        blocks_of = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
        sizes = every.groupBy(F.size("v").alias("size")).agg(blocks_of(F.count_if(is_query), QUERIES).alias("query_blocks"), blocks_of(F.count("*"), VECTORS).alias("vector_blocks"))
        every = every.withColumn("size", F.size("v")).join(F.broadcast(sizes), "size")
        # All of a query's scores lie within lo and hi, from -2**m to 2**m - 1 with m 63 at the most; a bin's width is a power of two.
        m = (F.ceil(F.least(F.log2(norm("v") * longest * (1 + 1e-9) + 1), F.lit(62.0))) + 1).cast("int")
        asked = every.where(is_query).withColumn("m", m)
        lo, hi = F.expr("shiftleft(-1L, m)"), F.expr("~shiftleft(-1L, m)")
        kept = ["size", "i", "vector_blocks", "row", "query_id", "v"]
        state = asked.select("size", dealt("query_blocks").alias("i"), "vector_blocks", "row", F.col("vec_id").alias("query_id"), whole.alias("v"), lo.alias("lo"), hi.alias("hi"), F.greatest(F.lit(0), F.col("m") + 1 - BITS).alias("shift"), F.lit(k).alias("need"))
        queries = written(state, "queries")
        row = F.sort_array(F.collect_list(F.struct("vec_id", "row", whole.alias("v")))).alias("rows")
        blocks = written(every.withColumn("j", dealt("vector_blocks")).groupBy("size", "j", "query_blocks").agg(row), "blocks")
        from_above = Window.partitionBy("row").orderBy(F.desc("bin"))
        width = queries.agg(F.max("shift")).first()[0]
        while width is not None and width >= 0:
            counts = met(queries, blocks, histograms, "row long, bin int, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
            above = counts.withColumn("above", F.sum("n").over(from_above) - F.col("n"))
            hit = above.join(queries.select("row", "need"), "row").where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))).select("row", "bin", "above")
            # Without a hit there are fewer candidates than k: all lie above the interval's start.
            some = F.col("bin").isNotNull()
            start = F.when(some, F.expr("shiftleft(shiftright(lo, shift) + bin, shift)")).otherwise(F.col("lo"))
            end = F.when(some, F.expr("shiftleft(shiftright(lo, shift) + bin, shift) + ~shiftleft(-1L, shift)")).otherwise(F.col("hi"))
            finer = F.when(some, F.greatest(F.lit(0), F.col("shift") - BITS)).otherwise(F.col("shift"))
            state = queries.join(hit, "row", "left").select(*kept, start.alias("lo"), end.alias("hi"), finer.alias("shift"), (F.col("need") - F.coalesce("above", F.lit(0))).cast("int").alias("need"))
            queries = written(state, "queries")
            width = width - BITS if width <= 0 or width > BITS else 0
        found = met(queries, blocks, selected, "row long, query_id long, vec_id long, score long")
        best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)  # of k rows and ties of each block
        return written(ranked.select("query_id", "rank", "vec_id", "score"), "top", outside=True)


#: The same in DuckDB, over all pairs.
ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
