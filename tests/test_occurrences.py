"""The index of occurrences against predicates over whole texts, texts against names by plain search, and what leaves the scan."""

import random
import time

import pytest
from pyspark.sql import functions as F

from refscan.functions.predicates import CANDIDATES, VERIFIERS, content_candidate
from refscan.operators import candidates, detectors
from refscan.operators.context import contexts
from refscan.sources import fixtures
from tests.conftest import DATA

PARTS = ["i:", ";", ",", '"id":', '"id": ', '"id":"', '"', "s:2:\"", "s:", ":\"", "wp-image-", '"ids":[', '"ids": [', "]", "[", "[gallery ids=\"", "[gallery x='1' ids='", "'", " ", "\n", "a", "ids=\"", "\t", "]]"]
CTX = "attachment_id long, id_text string, parent_id long, basenames array<string>"


def test_forms_are_those_of_whole_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice([*PARTS, str(rng.choice([1, 12, 123, 3, 23, 7])), str(rng.choice([1, 12, 123])), "012"]) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    texts += ["", "12", " 12\n", "12,", ",12", "1,12,3", "4, 12 ,9", '{"id":12.5}', '{"id": 12} {"id":123}', '[gallery ids="1" ids="12"]', '[gallery ids="1]2,12"', '"ids":[1,"ids":[12]', "[gallery]ids=\"12\"", '"ids":[12', 's:2:"12"', 's:12:"12"', "9" * 25]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, v string")
    ids = spark.createDataFrame([(i, str(i), 0, []) for i in (1, 12, 123, 3, 23, 7)], CTX)
    v, i = F.col("v"), F.col("id_text")
    plain = VERIFIERS | {f"find_{n}": p for n, p in CANDIDATES.items()} | {"find_content": content_candidate}
    every = rows.crossJoin(ids).select("row_id", "attachment_id", *(F.coalesce(p(v, i), F.lit(False)).alias(n) for n, p in plain.items())).collect()
    for forms in (candidates.META, candidates.CONTENT):
        met = candidates.mentions(rows, "row_id", "v", ids, forms, every_prefix=True)
        got = {(r.row_id, r.attachment_id): r for r in met.select("row_id", "attachment_id", *(candidates.has(F.col("bits"), f).alias(f) for f in forms)).collect()}
        for form in forms:
            want = {(r.row_id, r.attachment_id) for r in every if r[form]}
            assert {k for k, r in got.items() if r[form]} == want, form
            assert want
        # Without other prefixes than the text's own numbers, nothing that is accepted is lost.
        less = {(r.row_id, r.attachment_id): r.bits for r in candidates.mentions(rows, "row_id", "v", ids, forms).collect()}
        accepted = sum(candidates.BIT[f] for f in forms if not f.startswith("find_"))
        full = {(r.row_id, r.attachment_id): r.bits for r in met.collect()}
        assert all(less.get(k, 0) == b for k, b in full.items() if b & accepted)


@pytest.mark.parametrize("kind", ["short", "long", "mixed"])
def test_names_without_extension(spark, kind):
    """Found as by a plain search; no text emits more entries than it has characters, however many lengths names have."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcü😀-") for _ in range(n))
    lengths = {"short": range(1, 6), "long": range(6, 40), "mixed": range(1, 60)}[kind]
    names = list({word(n) for n in lengths for _ in range(3)})
    texts = [word(rng.randrange(1, 120)) for _ in range(60)] + ["".join(rng.choice(names) + word(rng.randrange(3)) for _ in range(rng.randrange(1, 5))) for _ in range(60)] + names + ["", "b", "x" * 50]
    ctx = spark.createDataFrame([(i, str(i), 0, [n]) for i, n in enumerate(names)], CTX)
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, v string")
    got = {(r.k, r.attachment_id) for r in candidates.name_pairs(rows, "k", "v", ctx).collect()}
    assert got == {(k, i) for k, t in enumerate(texts) for i, n in enumerate(names) if n in t}
    about = candidates.known(ctx, ids=False)
    emitted = candidates.entries(rows.select(F.col("k").alias("row"), F.col("v").alias("text")), ["row"], None, f"array({candidates.a_text('text', 'name')})", about)
    assert all(r["count"] <= 2 * len(texts[r["row"]]) for r in emitted.groupBy("row").count().collect())


def test_long_gallery_is_linear(spark):
    """The text is read once, not once for each id that it lists."""
    took = {}
    for n in (1_000, 4_000, 64_000):
        ids = spark.range(1, n + 1).select(F.col("id").alias("attachment_id"), F.col("id").cast("string").alias("id_text"), F.lit(0).cast("long").alias("parent_id"), F.array().cast("array<string>").alias("basenames"))
        rows = spark.createDataFrame([(1, '<!-- wp:gallery {"ids":[' + ",".join(map(str, range(1, n + 1))) + "]} -->")], "row_id long, v string")
        began = time.perf_counter()
        assert candidates.mentions(rows, "row_id", "v", ids, candidates.CONTENT).where(candidates.has(F.col("bits"), "gallery_block")).count() == n
        took[n] = time.perf_counter() - began
    assert took[64_000] < 60


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan(spark):
    """One explode over all text tables; no text behind it; each table read twice at most; nothing runs while the plan is made."""
    site = fixtures.site(spark, f"{DATA}/sf0.001")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    refs = detectors.all_references(site, contexts(site.attachments))
    assert not tracker.getJobIdsForGroup("building")
    text = plan_of(refs)
    spark.sparkContext.setJobGroup("", "")
    main = text.split("Subquery")[0]
    assert main.count("Generate explode") <= 3  # entries, lengths of anchors, names
    after = [line for line in main.splitlines() if "Exchange" in line]
    assert after and not any(c in line for line in after for c in ("post_content", "meta_value", "option_value"))


def test_what_leaves_the_scan(spark):
    """Entries that the bitmap lets through are little more than those that match."""
    site = fixtures.site(spark, f"{DATA}/sf0.1")
    about = candidates.known(contexts(site.attachments))
    rows = detectors.postmeta_texts(site).withColumn("ord", F.lit(0)).unionByName(detectors.content_texts(site).withColumn("ord", F.lit(1)))
    found = candidates.entries(rows, detectors.ROW, candidates.numbers("text", candidates.META), f"array({candidates.a_text('text', 'name')})", about)
    sent = found.count()
    matching = found.join(about.keys.select("kind", "k").distinct(), ["kind", "k"], "left_semi").count()
    assert 0 < sent <= 1.2 * matching
