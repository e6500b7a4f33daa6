"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample. Every vector goes to a leaf. A query walks the tree with a priority
queue: the node with the largest inner product of query and centroid is opened next, until enough
leaves are visited; how many that is, is widened on sampled queries, on which the tree was not fitted, until they find
``RECALL`` of their brute-force neighbours among the sampled vectors that it was not fitted on either. The branches two levels down are buckets: a query goes once to each bucket
in which it visits leaves, and meets its vectors in blocks of bounded size; only a block's best go on.
Nearness is the inner product in double precision on the original vectors.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, written

#: Vectors that are sampled, at the most (in expectation), for the tree (every other one) and the calibration (the rest); its queries.
SAMPLE, CALIBRATION = 32_000, 400
BUCKET_DEPTH = 2
BRANCH, LEAF = 8, 100  # children of a node; sampled vectors of a leaf, at the most (where they differ)
RECALL = 0.96
BLOCK = 1024


@dataclass
class Node:
    centroid: np.ndarray
    children: list[Node] = field(default_factory=list)
    leaf: int = -1
    centroids: np.ndarray | None = None


def split(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means: the cluster of each row."""
    centers = x[rng.choice(len(x), BRANCH, replace=False)]
    for _ in range(rounds):
        label = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        centers = np.array([x[label == k].mean(0) if (label == k).any() else x[rng.integers(len(x))] for k in range(len(centers))])
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)


class Tree:
    def __init__(self, x: np.ndarray):
        self.rng, self.leaves, self.buckets, bucket_of = np.random.default_rng(11), 0, 0, []
        self.root = self.grown(x, 0, bucket_of)
        self.bucket_of = np.array(bucket_of)  # by leaf

    def grown(self, x: np.ndarray, depth: int, bucket_of: list[int]) -> Node:
        node = Node(x.mean(0))
        if len(x) > LEAF and len(label := split(x, self.rng)) and len(kinds := np.unique(label)) > 1:
            node.children = [self.grown(x[label == k], depth + 1, bucket_of) for k in kinds]
            node.centroids = np.array([c.centroid for c in node.children])
        else:
            node.leaf = self.leaves
            self.leaves += 1
            bucket_of.append(self.buckets)
        if depth == BUCKET_DEPTH or depth < BUCKET_DEPTH and not node.children:
            self.buckets += 1
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centroid at each level."""
        out = np.empty(len(x), np.int32)

        def down(node: Node, rows: np.ndarray) -> None:
            if not node.children:
                out[rows] = node.leaf
                return
            label = ((node.centroids**2).sum(1) - 2 * x[rows] @ node.centroids.T).argmin(1)
            for k, child in enumerate(node.children):
                if (label == k).any():
                    down(child, rows[label == k])

        down(self.root, np.arange(len(x)))
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        queue, n, out = [(0.0, 0, self.root)], 0, []
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if not node.children:
                out.append(node.leaf)
                continue
            for nearness, child in zip(node.centroids @ q, node.children, strict=True):
                n += 1
                heapq.heappush(queue, (-float(nearness), n, child))
        return out


def calibrated(tree: Tree, x: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that every so many of ``x``, as queries, find their share of the k nearest others in ``x``."""
    leaf = tree.leaf_of(x)
    at = np.arange(0, len(x), max(1, len(x) // CALIBRATION))[:CALIBRATION]
    nearness = x[at] @ x.T
    nearness[np.arange(len(at)), at] = -np.inf  # a query is not its own neighbour
    near = np.argsort(-nearness, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = [tree.visits(q, tree.leaves) for q in x[at]]
    most = 1
    while most < tree.leaves:
        found = np.mean([np.isin(leaf[n], o[:most]).mean() if len(n) else 1.0 for n, o in zip(near, order, strict=True)])
        if found >= recall:
            break
        most = min(tree.leaves, most + max(1, most // 10))
    return most


def by_bucket(tree: Tree, leaves: list[int]) -> list[dict]:
    """The visited leaves, by bucket."""
    found = defaultdict(list)
    for leaf in leaves:
        found[int(tree.bucket_of[leaf])].append(leaf)
    return [{"bucket": b, "leaves": own} for b, own in found.items()]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles): one row for each id, without null, zero or non-finite vectors and ids; of several lengths the most frequent takes part."""
    component = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), component.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = written(rows, "vectors")
    best = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (best["n"] if best else 0))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def rows_of(batch: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    return np.array(flat.flatten(), np.float64).reshape(len(flat), -1)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best_of(q: pa.Table, c: pa.Table, k: int, leaves: int) -> pa.Table:
    """The k nearest of a block's vectors for each of a block's queries, among the leaves that the query visits.

    A matrix product preselects with room for rounding; products of what is left are summed row by row in
    one order, so equal vectors get equal scores."""
    if not q.num_rows or not c.num_rows:
        return FOUND.empty_table()
    ids, query_ids = c["vec_id"].to_numpy(), q["query_id"].to_numpy()
    x, y = rows_of(q["vector"]), rows_of(c["vector"])
    visited = q["leaves"].combine_chunks()
    may = np.zeros((len(x), leaves), bool)
    may[np.repeat(np.arange(len(x)), np.diff(visited.offsets.to_numpy())), visited.flatten().to_numpy()] = True
    out = may[:, c["leaf"].to_numpy()] & (query_ids[:, None] != ids)
    room = 1e-12 * np.sqrt((x**2).sum(1).max() * (y**2).sum(1).max())
    rough = np.where(out, x @ y.T, -np.inf)
    if len(y) > k:
        out &= rough >= (np.partition(rough, len(y) - k, axis=1)[:, len(y) - k] - room)[:, None]
    row, at = np.nonzero(out)
    score = (x[row] * y[at]).sum(1)
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.Table.from_arrays([pa.array(query_ids[row[first]]), pa.array(ids[at[first]]), pa.array(score[first])], schema=FOUND)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others found for each row of ``vectors`` where ``is_query`` (of vec_id) holds.

    Ties go to the smaller vec_id. Vectors that are null, zero, of an unusual length or that hold null or
    non-finite components take no part, neither do null ids; of rows with one id the smallest vector counts.
    Of equal vectors the k + 1 smallest ids are candidates: no other can be among k. An empty table gives an
    empty result; other columns are ignored.

    Leaves are as many as the sample allows, so they grow with the table: they are met in blocks of bounded size."""
    spark = vectors.sparkSession
    every = usable(vectors)
    n = every.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = every.where(sampled(share, "vec_id")).orderBy("vec_id").toPandas()
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = stacked(sample["vector"])
    tree = Tree(x[::2]) if len(x) > 40 * k else Tree(x)
    most = calibrated(tree, x[1::2] if len(x) > 40 * k else x, k, recall)

    @F.arrow_udf("int")
    def leaf_of(batch: pa.Array) -> pa.Array:
        return pa.array(tree.leaf_of(rows_of(batch)), pa.int32())

    @F.arrow_udf("array<struct<bucket:int,leaves:array<int>>>")
    def visits(batch: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
        return pa.array([by_bucket(tree, tree.visits(q, most)) for q in rows_of(batch)], kind)

    bucket_of = F.array(*map(F.lit, tree.bucket_of.tolist()))
    copies = Window.partitionBy("vector").orderBy("vec_id")
    placed = every.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "vector", leaf_of("vector").alias("leaf"))
    candidates = written(placed.withColumn("bucket", bucket_of[F.col("leaf")]), "leaves")
    visited = every.where(is_query).select(F.col("vec_id").alias("query_id"), "vector", F.explode(visits("vector")).alias("v"))
    queries = written(visited.select("query_id", "vector", "v.bucket", "v.leaves"), "visits")
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    size = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    sizes = size(candidates, "blocks").join(size(queries, "query_blocks"), "bucket")
    left = queries.join(sizes, "bucket").withColumn("i", salt("query_id", "query_blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = candidates.join(sizes, "bucket").withColumn("j", salt("vec_id", "blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        return best_of(q, c, k, leaves)

    keys, leaves = ["bucket", "i", "j"], tree.leaves
    found = left.select(*keys, "query_id", "vector", "leaves").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vector", "leaf").groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
