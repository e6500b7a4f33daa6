"""MinHash near-duplicates by bottom-k sketches from one hash function.

1. Each text becomes a set of hashed word shingles and its ``k`` smallest hashes (one mapInArrow pass).
   Texts with equal sets are one class; only class representatives go on.
2. Inverted lists of retained values. Values are ordered rarest first; a text enters only the lists of
   its first ``retained - needed + 1`` values, as two texts over the threshold share ``needed`` of
   them. A phrase that many texts share is thus rarely looked up at all.
3. Short lists give all their pairs; a long list gives one pair for each member, with the member that
   shares most of its values with others (the original, in a group of edited copies).
4. The sketch of the union estimates the similarity and filters pairs; exact Jaccard on full sets verifies.
5. Members of long lists that are still outside their hub's component are compared with the whole
   list, in blocks of bounded size and on full sets, so no link is lost and no list is expanded to pairs.

For sets of up to 0.8 k shingles all of it is exact (so a ``k`` of 1.25 times the largest set makes it exact for
all). For larger ones ``needed`` is six standard deviations below the mean of the shared part of the
union's sketch at the threshold itself, so about one in a billion pairs that lie exactly on the threshold may be
missed, and none much above it.

A group of copies is one class. Its rows are dealt to parts by a hash of their ids, before classes are formed and
when they are looked up again, so no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, salts, slices, temporary, written

#: Lists of up to this length give all their pairs.
SHORT = 24
#: Bits of the bitmap that preselects candidates' texts (4 MB).
BITS = 1 << 25
#: Hashes of full sets in a block of the last comparison, at most, unless one set is larger.
BLOCK = 400_000


class WordHashes(dict):
    """Hash of each word; emptied when it gets large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values: its order is the order of the sketch."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all shingles of ``width`` words; fewer words: the whole sequence as one."""
    words = text.lower().split()  # of bytes: lower-cases A-Z and splits at \x20 and \x09-\x0D alone
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - width + 1)
    out = np.full(n, min(len(ids), width), np.uint64)
    for i in range(min(len(ids), width)):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n])
    return np.unique(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned values as Spark's longs in the same order: with the top bit flipped."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def sketched(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n (set size), sig (digest of the set), sketch (its k smallest hashes, signed() for Spark to order them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [shingles(t, width, hashes) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([signed(s[:k]) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n", "sig", "sketch"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n long, sig binary, sketch array<long>")


def marked_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits with the hashes of ``nodes``: its size is fixed, so a large corpus only makes it less selective."""
    at = nodes.select((F.pmod(F.xxhash64("node"), F.lit(BITS)) + 1).alias("bit"))
    rows = at.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, set: the full sets of the documents that candidates name (of each text, where an id has several). A bitmap of
    them spares most other texts the shuffle; the join then is exact."""
    bits = docs.sparkSession.sparkContext.broadcast(marked_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits.value[bit >> 3] >> (bit & 7)) & 1 == 1))
            sets = [shingles(t, width, hashes) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "sig", "set"])

    rows = id_and_text(docs).where("doc_id IS NOT NULL").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)))
    return rows.mapInArrow(run, "node long, sig binary, set array<long>").join(nodes, "node", "left_semi").dropDuplicates(["node", "sig"]).drop("sig")


def needed(n: Column, k: int, percent: int) -> Column:
    """How many retained values a set of n shares, at the least, with one over the threshold."""
    t = percent / 100
    union = n / t
    spread = 6 * F.sqrt(t * (1 - t) * k * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (union - k) / F.greatest(union - 1, F.lit(1.0)))))
    exact = F.ceil(n * t - F.lit(1e-9))
    return F.greatest(F.lit(1), F.when(n <= int(k * t), exact).otherwise(F.least(exact, F.floor(t * k - spread)))).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of ``edges`` (a, b) reaches.

    Minimum labels spread along links and are then followed to the label's own label, so chains
    shorten by half each round; every round is a written table."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left, right = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    found = pairs.select("a", "b").join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return found.where(100 * F.col("both") >= percent * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def estimated(pairs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose union sketch has as many values of both as the threshold asks for."""
    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    found = pairs.join(right, "b").join(left, "a")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    return found.where(shared >= F.least(needed(F.col("n_a"), k, percent), needed(F.col("n_b"), k, percent))).select("a", "b")


def links(docs: DataFrame, sketches: DataFrame, width: int, k: int, percent: int) -> DataFrame:
    """Links (a, b) between class representatives that join all that belongs together; see the module's text."""
    values = sketches.select("node", "sig", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ordered = values.join(shared, "v").groupBy("node", "sig", "n", "k").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))  # k values at most
    lists = written(ordered.withColumn("first", F.size("vs") - needed(F.col("n"), k, percent) + 1).where("first > 0").select("node", "n", (F.size("vs") / F.col("k")).alias("common"), F.explode(F.slice("vs", F.lit(1), F.col("first"))).alias("x")).select("node", "n", "common", F.col("x.v").alias("v")), "lists")

    sizes = lists.groupBy("v").agg(F.count("*").alias("m"), F.max_by("node", F.struct("common", -F.col("node"))).alias("hub")).where("m > 1")
    listed = written(lists.join(sizes, "v"), "listed")
    alike = lambda x, y: (100 * x >= percent * y) & (100 * y >= percent * x)
    short = listed.where(F.col("m") <= SHORT)
    one, two = (short.select("v", F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    inner = one.join(two, "v").where((F.col("a") < F.col("b")) & alike(F.col("n_a"), F.col("n_b"))).select("a", "b")
    long = listed.where(F.col("m") > SHORT)
    star = long.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = written(estimated(inner.union(star).distinct(), sketches, k, percent), "pairs")

    hubs = written(long.select("hub", "node").distinct(), "hubs")
    if hubs.isEmpty():
        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return verified(pairs, full_sets(docs, named, width), percent)
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(hubs.select("node")).distinct()
    sets = written(full_sets(docs, named, width), "sets")
    found = written(verified(pairs, sets, percent), "verified")
    return found.union(outsiders(hubs, components(found), sets, percent))


def outsiders(hubs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the members of long lists that aren't in their hub's component and all of the same hub's members."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"component_{c}"))
    members = hubs.join(label("node"), "node", "left").join(label("hub"), "hub", "left").select("hub", "node", F.coalesce("component_node", "node").alias("component"), F.coalesce("component_hub", "hub").alias("main"))
    left = members.groupBy("hub").agg(F.count_if(F.col("component") != F.col("main")).alias("outside")).where("outside > 0")
    sized = members.join(left, "hub").join(sets, "node").withColumn("blocks", F.lit(None).cast("long"))
    total = sized.groupBy("hub").agg(F.ceil(F.sum(F.size("set")) / BLOCK).alias("all_blocks"), F.ceil(F.sum(F.when(F.col("component") != F.col("main"), F.size("set"))) / BLOCK).alias("out_blocks"))
    rows = written(sized.drop("blocks").join(total, "hub"), "members")
    salt = lambda n: F.pmod(F.xxhash64("node"), n)
    queries = rows.where("component <> main").withColumn("i", salt(F.col("out_blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)))
    against = rows.withColumn("j", salt(F.col("all_blocks"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)))

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return linked_blocks(q, x, percent)

    keys = ["hub", "i", "j"]
    some = ["node", "component", "set"]
    return queries.select(*keys, *some).groupBy(*keys).cogroup(against.select(*keys, *some).groupBy(*keys)).applyInPandas(compare, "a long, b long")


def linked_blocks(q: pd.DataFrame, x: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of different components over the threshold between two blocks of sets."""
    none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    if q.empty or x.empty:
        return none
    sizes = x["set"].map(len).to_numpy()
    flat = np.concatenate(x["set"].to_numpy())
    owner = np.repeat(np.arange(len(x)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for node, component, one in zip(q["node"], q["component"], q["set"], strict=True):
        lo, hi = np.searchsorted(flat, one, "left"), np.searchsorted(flat, one, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(x))
        hit = (100 * both >= percent * (len(one) + sizes - both)) & (x["component"].to_numpy() != component)
        out += [(node, other) for other in x["node"].to_numpy()[hit]]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else none


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, class_id, component_id, kept; one row for each row of ``docs``.

    ``class_id`` is the smallest doc_id with the same shingle set, ``component_id`` the smallest one
    reachable over links. Texts that are null, empty or white space have an empty set: they are linked
    with nothing and kept. Rows that repeat a doc_id are one document, which has the links of all its texts. A null
    doc_id takes no part: null ids, kept. Very long texts are taken whole, one at a time. An empty table gives
    an empty result; other columns are ignored."""
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id"), F.lit(salts(spark))).alias("part")
    sk = written(sketched(docs, width, k), "sketches")
    full = sk.where("n > 0 AND doc_id IS NOT NULL").select("*", part)
    with temporary(spark):
        parts = written(full.groupBy("sig", "n", "part").agg(F.min("doc_id").alias("low")), "class-parts")
        classes = written(parts.groupBy("sig", "n").agg(F.min("low").alias("class_id")), "classes")
        known = written(parts.drop("low").join(classes, ["sig", "n"]), "known-classes")  # as many rows for a class as it has parts
        reps = full.join(classes.withColumnRenamed("class_id", "doc_id"), ["sig", "n", "doc_id"], "left_semi").dropDuplicates(["doc_id", "sig"]).select(F.col("doc_id").alias("node"), "sig", "n", "sketch")
        several = full.groupBy("doc_id").agg(F.min(F.xxhash64("sig")).alias("one"), F.max(F.xxhash64("sig")).alias("other")).where("one <> other").select("doc_id")
        own = full.join(several, "doc_id", "left_semi").join(known, ["sig", "n", "part"]).where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
        labels = components(links(docs, written(reps, "reps"), width, k, percent).union(own))
        joined = known.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
        known = written(joined.select("sig", "n", "part", "class_id", F.coalesce("component", "class_id").alias("component_id")), "components", outside=True)
    out = sk.select("doc_id", "n", "sig", part).join(known, ["sig", "n", "part"], "left")
    alone = F.col("doc_id").isNull()
    own = lambda c: F.when(~alone, F.coalesce(c, "doc_id")).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("class_id"), own("component_id"), (alone | (F.coalesce("component_id", "doc_id") == F.col("doc_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows and columns of ``docs`` but for near-duplicates of a document with a smaller id; null ids stay.

    Nulls, empty and long texts and empty tables as in ``near_duplicates``; other columns stay, whatever their names.
    The result is read from two written tables, ``docs`` and the ids that go."""
    (gone_id,) = fresh(docs, "gone_id")
    with temporary(docs.sparkSession):
        gone = written(near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct(), "near-duplicates", outside=True)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[gone_id], "left_anti")
