import zlib
from collections import Counter
from itertools import pairwise

from pyspark.sql import functions as F

import corpus_pipeline
from refscan.llm import mixing, quality
from refscan.llm.common import written
from tests.conftest import DATA

from .test_minhash import brute
from .test_packing import full, tokenizer, valid


def lines(name, n):
    return [f"{name} line {i} with several words of its own {name}{i}" for i in range(n)]


def test_repeated_passages_go_from_texts_that_they_dominate(spark):
    p, q = lines("p", 30), lines("q", 30)
    a, b, c = lines("a", 40), lines("b", 40), lines("c", 8)
    texts = {1: a + p, 2: b + q, 3: p + c, 4: p[:20] + q[:20], 5: [*b, *q[:-1], "another end"], 6: [], 7: a + p}
    rows = [(i, "\n".join(x), len("\n".join(x)), "x") for i, x in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")
    out = corpus_pipeline.line_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    found = {r.doc_id: r for r in out.collect()}
    assert found[1].text == rows[0][1] and found[2].text == rows[1][1]  # first occurrences stay
    assert found[5].text == "another end" and 7 not in found and found[6].text == ""  # of a near-copy its own line stays; an exact copy goes; an empty text was not emptied
    left = found[3].text.split("\n")
    assert left[-8:] == c and len(left) < 8 + 10 and found[3].n_chars == len(found[3].text)
    mixed = found[4].text.split("\n") if 4 in found else []
    assert len(mixed) < 20


def test_nothing_is_left(spark):
    passage = [" ".join(f"{x}{i}" for i in range(60)) for x in "pq"]
    texts = {1: ["a b c", passage[0], "d e " * 40], 2: ["f g", passage[1], "h i " * 40], 3: passage}
    docs = spark.createDataFrame([(i, "\n".join(x), 1) for i, x in texts.items()], "doc_id long, text string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()) == [1, 2]


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark):
    """Every stage on what its predecessor kept, by properties that follow from its operator."""
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = written(stage(spark, list(kept.values())[-1], sf), f"test-{name}")
        if name != "packing":
            assert kept[name].columns == COLUMNS and kept[name].schema == docs.schema
    rows = {k: {r.doc_id: r for r in v.collect()} for k, v in kept.items() if k != "packing"}
    scores = {r.doc_id: r.predicted for r in quality.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(rows["quality"]) == {i for i, p in scores.items() if p == 1}
    assert all(rows["quality"][i].text == rows[""][i].text for i in rows["quality"])

    seen, left = set(), {}
    for i in sorted(rows["quality"]):
        lines = rows["quality"][i].text.split("\n")
        some = [(n, x) for n, x in enumerate(lines) if x.strip()]
        gone = set()
        for (a, x), (b, y) in pairwise(some):
            gone |= set(range(a, b + 1)) if (x, y) in seen else set()
            seen.add((x, y))
        for n, x in some:
            if len(x.split(" ")) >= 50:
                gone |= {n} if x in seen else set()
                seen.add(x)
        text = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        if not gone or text.strip():
            left[i] = text
    assert {i: r.text for i, r in rows["line_dedup"].items()} == left
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"].values())

    component, _ = brute(list(left.items()), 5)
    assert set(rows["near_dedup"]) == {i for i, c in component.items() if i == c}
    times = Counter(r.doc_id for r in kept["mixing"].collect())
    assert set(times) <= set(rows["near_dedup"]) and all(r.text == left[r.doc_id] for r in kept["mixing"].collect())
    rates = {r.doc_id: r for r in mixing.mixed(kept["near_dedup"], mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet")), corpus_pipeline.WEIGHTS, anchor="clean").collect()}
    assert times == Counter({i: r.copies for i, r in rates.items() if r.copies})
    tok = tokenizer()
    want = Counter()
    for r in kept["mixing"].collect():
        ids = full([r.text], tok)[0]
        want.update((r.doc_id, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048)))
    packed = kept["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    valid(packed)
    again = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_stages_take_odd_tables(spark):
    """Nulls everywhere, empty and long texts, ties, clashing names, no rows."""
    long = "\n".join(f"line {i} of a long text with words w{i * 7919 % 10007}" for i in range(8_000))
    rows = [(1, None), (2, ""), (None, "some words\nof a text"), (3, "some words\nof a text"), (3, "some words\nof a text"), (4, long), (None, None)]
    extra = {c: F.lit(f"mine {c}") for c in ("_id", "_text", "_gone_id", "_copy", "_report", "line_dedup", "n_lines", "score", "part", "_copies")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra).withColumn("n_chars", F.lit(None).cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        if name != "packing":
            assert out.columns == docs.columns
            got = out.collect()
            assert all(r[c] == f"mine {c}" for r in got for c in extra) and len(got) >= 1, name
        else:
            assert Counter(r.doc_id for r in out.where("piece = 0").collect()) == Counter(i for i, _ in rows)
        assert stage(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0, name
