"""Merkle manifest of a dataset: a digest of each row, trees of arity three over the rows of each source, one over the sources.

Children are combined by the key of their parent, as events: a task that holds rows keeps partial parents, each with the digests
of the children that have come, by place. As many children as the tree's size says make a parent whole; it
becomes a child itself, and so on. Rows are dealt to tasks in the order of leaves, so that all but the
parents at a task's edges are whole in one task. What is left, the frontier, is dealt anew, by ancestors that reach over more
and more parts, until only the trees' roots are left. Each node keeps a link back to the last ancestor that its task
could make and the siblings on that way; the links put together are the proofs.
No task holds a source: what it keeps is its own rows, and the frontiers of bounded numbers of parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import temporary, written

ARITY = 3
#: Levels by which the ancestors that a frontier is dealt by rise in each round.
RISE = 2
#: What a row's digest is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

ROW_BITS = 33  # of monotonically_increasing_id: a row's number in its part
NODE = ("tree", "total", "level", "place", "digest")
STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
LINK = [T.StructField("steps", STEPS), T.StructField("up_level", T.IntegerType()), T.StructField("up_place", T.LongType()), T.StructField("up_digest", T.StringType())]


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of values: each as its UTF-8 length, a colon and itself, or a dash if null."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return joined_hash(*(field(c.cast("string")) for c in values))


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of a proof."""
    return F.aggregate(proof, digest, lambda acc, step: joined_hash(step["left"], acc, step["right"]))


class Forest:
    """Partial parents of many trees, and those that became whole."""

    def __init__(self):
        self.waiting: dict[tuple[str, int, int], list[str | None]] = {}  # by tree, children's level and parent's place
        self.whole: dict[tuple[str, int, int], list[str]] = {}
        self.tops: dict[tuple[str, int, int], str] = {}  # digests of whole parents

    def add(self, tree: str, total: int, level: int, place: int, digest: str) -> None:
        while (size := -(-total // ARITY**level)) > 1:
            parent = place // ARITY
            key = (tree, level, parent)
            children = self.waiting.get(key)
            if children is None:
                children = self.waiting[key] = [None] * min(ARITY, size - ARITY * parent)
            children[place - ARITY * parent] = digest
            if None in children:
                return
            self.whole[key] = self.waiting.pop(key)
            digest = sha256("".join(children).encode()).hexdigest()
            level, place = level + 1, parent
            self.tops[tree, level, place] = digest

    def climbed(self, tree: str, level: int, place: int, digest: str) -> tuple[list[str], list[str], int, int, str]:
        """From a node to its last whole ancestor: what stands left and right of it at each level, and the ancestor."""
        left, right = [], []
        while (children := self.whole.get((tree, level, place // ARITY))) is not None:
            at = place % ARITY
            left.append("".join(children[:at]))
            right.append("".join(children[at + 1 :]))
            level, place = level + 1, place // ARITY
        return left, right, level, place, self.tops.get((tree, level, place), digest)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with the link to its last ancestor that the task's nodes make whole; the ancestor's digest is named once."""
    forest, kept, named = Forest(), [], set()
    for batch in batches:
        kept.append(batch)
        for node in zip(*(batch[c].to_pylist() for c in NODE), strict=True):
            forest.add(*node)
    for batch in kept:
        lefts, rights, ends, ups = [], [], [0], []
        for tree, _, *own in zip(*(batch[c].to_pylist() for c in NODE), strict=True):
            left, right, level, place, digest = forest.climbed(tree, *own)
            lefts += left
            rights += right
            ends.append(len(lefts))
            key = (tree, level, place)
            ups.append((level, place, None if key in named else digest))
            named.add(key)
        steps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"]))
        levels, places, digests = zip(*ups, strict=True) if ups else ((), (), ())
        more = [steps, pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(f.name for f in LINK)])


def links(nodes: DataFrame) -> DataFrame:
    return nodes.mapInArrow(linked, T.StructType([*nodes.schema.fields, *LINK]))


def frontier(found: DataFrame) -> DataFrame:
    """The ancestors that links lead to, as nodes."""
    return found.where("up_digest IS NOT NULL").select("tree", "total", F.col("up_level").alias("level"), F.col("up_place").alias("place"), F.col("up_digest").alias("digest"))


def grown(leaves: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over ``leaves`` (tree, digest, payload and the columns of ``order``; ties by digest).

    Returns the leaves' links (tree, payload, digest, steps, up_level, up_place), the way from there to the
    root (tree, level, place, steps), and the roots (tree, digest)."""
    by = ["tree", *order, "digest", "_seq"]
    own = written(leaves.withColumn("_seq", F.monotonically_increasing_id()), "leaves")  # so that rows that are alike are dealt out, too
    ordered = own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("_part", F.shiftright("_row", ROW_BITS)), "ordered-leaves")
    # Where the rows of a part stand in their tree: a row for each part and tree, of one tree as many as there are parts.
    window = Window.partitionBy("tree")
    starts = ordered.groupBy("_part", "tree").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    before = F.coalesce(F.sum("n").over(window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(starts.select("_part", "tree", "n", (before - F.col("first")).alias("shift"), F.sum("n").over(window).alias("total")), "starts")
    placed = ordered.join(starts, ["_part", "tree"]).select("tree", "total", F.lit(0).alias("level"), (F.col("_row") + F.col("shift")).alias("place"), "digest", "payload")
    found = [written(links(placed), "links")]
    # A frontier is dealt by ancestors that reach over some parts, then over more.
    height, most = 0, starts.agg(F.max("n")).first()[0] or 1
    while ARITY**height < most:
        height += 1
    open_ = F.pow(F.lit(float(ARITY)), F.col("level")) < F.col("total")
    while len(found) == 1 or not frontier(found[-1]).where(open_).isEmpty():
        height += RISE
        above = F.pow(F.lit(float(ARITY)), F.greatest(F.lit(0), F.lit(height) - F.col("level")))
        found.append(written(links(frontier(found[-1]).repartition("tree", F.floor(F.col("place") / above))), "frontier"))
    ways = None
    for step in reversed(found[1:]):
        own = step.select("tree", "level", "place", "steps", "up_level", "up_place")
        if ways is not None:
            upper = ways.select("tree", F.col("level").alias("up_level"), F.col("place").alias("up_place"), F.col("steps").alias("rest"))
            own = own.join(upper, ["tree", "up_level", "up_place"]).withColumn("steps", F.concat("steps", "rest"))
        ways = own.select("tree", "level", "place", "steps")
    return found[0].select("tree", "payload", "digest", "steps", "up_level", "up_place"), ways, frontier(found[-1]).select("tree", "digest")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof and the ``carried`` columns: a row for each row of ``docs``.

    leaf: the digest of the ``fields``. proof: for each level on the way to the root, the digests left and right of the node there,
    joined; ``folded`` gives the root from it. Rows of a source ascend by doc_id, null ids first, of equal ids by digest;
    sources by their bytes, null first, so a null and an empty source are two. Null, empty and very
    long texts are values like others; repeated rows are leaves of their own; a lone leaf is its source's subroot, a lone
    source's subroot the root; an empty table gives an empty result. Columns that aren't named are ignored."""
    source, doc_id = F.col("source").cast("string"), F.col("doc_id").cast("long")
    tree = F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # null before all others
    payload = F.struct(doc_id.alias("doc_id"), source.alias("source"), *(F.col(c).alias(f"carried{n}") for n, c in enumerate(carried)))
    rows = docs.select(tree.alias("tree"), doc_id.alias("doc_id"), leaf(*map(F.col, fields)).alias("digest"), payload.alias("payload"))
    with temporary(docs.sparkSession):
        found, ways, roots = grown(rows, ["doc_id"])
        subroots = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.struct(F.col("tree").alias("name")).alias("payload"))
        tops, top_ways, top = grown(subroots, ["name"])
        upper = top_ways.select(F.col("level").alias("up_level"), F.col("place").alias("up_place"), F.col("steps").alias("rest"))
        whole = tops.join(upper, ["up_level", "up_place"]).select(F.col("payload.name").alias("tree"), F.col("digest").alias("subroot"), F.concat("steps", "rest").alias("to_root"))
        root = top.select(F.col("digest").alias("root"))  # one row
        # From each end of a leaf's link to the root: as many rows as parts and sources have frontiers.
        ways = ways.join(whole, "tree").crossJoin(F.broadcast(root)).select("tree", F.col("level").alias("up_level"), F.col("place").alias("up_place"), F.concat("steps", "to_root").alias("rest"), "subroot", "root")
        ways = written(ways, "ways")
        found = written(found.join(ways, ["tree", "up_level", "up_place"]).select("payload", "digest", "subroot", "root", F.concat("steps", "rest").alias("proof")), "proofs", outside=True)
    return found.select("payload.doc_id", "payload.source", F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"payload.carried{n}").alias(c) for n, c in enumerate(carried)))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest, and what it says of documents of which some have lost their newlines."""
    doc_id = F.col("doc_id").cast("long")
    cut = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(2)) == 0  # null ids: not
    tampered = leaf(*(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS))
    rows = docs.select(*FIELDS).withColumn("tampered", F.when(cut, tampered))
    found = manifest(rows, carried=["tampered"])
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    seen = found.select("doc_id", "leaf", "subroot", "root", joined_hash(siblings).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return seen.withColumn("verified", F.col("folded_root") == F.col("root"))


def level_sql(n: int, nodes: str, walks: str) -> str:
    """From level n - 1 to n: runs of three become their hash, and each walk gets its siblings there."""
    return f"""{nodes}{n} AS MATERIALIZED (
  SELECT tree, place // 3 AS place, any_value(ceil(size / 3)::BIGINT) AS size, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest,
    CASE WHEN any_value(size) > 1 THEN list(digest ORDER BY place) ELSE [] END AS run FROM {nodes}{n - 1} GROUP BY tree, place // 3
), {walks}{n} AS MATERIALIZED (
  SELECT w.* EXCLUDE (place, proof, folded), w.place // 3 AS place,
    w.proof || array_to_string(list_concat(run[:w.place % 3], run[w.place % 3 + 2:]), '') AS proof,
    CASE WHEN len(run) = 0 THEN w.folded ELSE sha256(array_to_string(list_concat(run[:w.place % 3], [w.folded], run[w.place % 3 + 2:]), '')) END AS folded
  FROM {walks}{n - 1} w JOIN {nodes}{n} n ON w.tree = n.tree AND w.place // 3 = n.place
)"""


LEVELS, TOP_LEVELS = 14, 6  # enough for 3 ** 14 rows of a source and 3 ** 6 sources
CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    of_byte = "list_reduce(list_prepend(xor(c, b), [0::BIGINT for i in range(8)]), lambda x, y: " + CRC_STEP.format("x") + ")"
    codes = f"list_transform(string_split({text}, ''), lambda b: ascii(b)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {of_byte}, 4294967295::BIGINT), 4294967295)"


def oracle() -> str:
    """The same in DuckDB, level by level over all nodes."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in FIELDS).replace(field("text"), field(text)) + ")"
    rows = f"""leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM (
    SELECT doc_id, coalesce('=' || source, '') AS tree, {digest('text')} AS leaf, CASE WHEN {crc_sql('doc_id::VARCHAR')} & 1 = 0 THEN {digest("replace(text, chr(10), '')")} END AS tampered FROM documents)
), n0 AS MATERIALIZED (SELECT tree, place, size, leaf AS digest, []::VARCHAR[] AS run FROM leaves), w0 AS MATERIALIZED (SELECT doc_id, leaf, tree, tree AS name, place, '' AS proof, coalesce(tampered, leaf) AS folded FROM leaves)"""
    first = ", ".join(level_sql(n, "n", "w") for n in range(1, LEVELS + 1))
    tops = f"""t0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size, digest, []::VARCHAR[] AS run, tree AS name FROM n{LEVELS}
), v0 AS MATERIALIZED (SELECT w.doc_id, w.leaf, '' AS tree, w.name, t.place, t.digest AS subroot, w.proof, w.folded FROM w{LEVELS} w JOIN t0 t ON t.name = w.name)"""
    second = ", ".join(level_sql(n, "t", "v") for n in range(1, TOP_LEVELS + 1))
    return f"WITH {rows}, {first}, {tops}, {second}\nSELECT v.doc_id, v.leaf, v.subroot, t.digest AS root, sha256(v.proof) AS proof_sha256, v.folded AS folded_root, v.folded = t.digest AS verified FROM v{TOP_LEVELS} v CROSS JOIN t{TOP_LEVELS} t"


ORACLE = oracle()
