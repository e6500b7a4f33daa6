import time

import numpy as np
from pyspark.sql import functions as F

from refscan.llm import toxicity
from tests.conftest import DATA

from .test_quality import auc


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows.score.to_numpy(), rows.toxic.to_numpy()) > 0.85
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and (rows.predicted == (rows.score >= 0.3)).all()
    sure = rows[rows.predicted == 1]
    assert sure.toxic.mean() > 0.7 and abs(rows.score.mean() - rows.toxic.mean()) < 0.05  # calibrated


def test_features():
    f = toxicity.Features({"vile": 3.0})
    plain = f.of(b"some calm words")
    rude = f.of("You are an IDIOT, vile! sc*m id1ot".encode())
    assert plain[:9] == [0.0] * 9 and rude[0] > 0 and rude[1] > rude[0] and rude[3] == 3.0 and rude[7] > 0 and rude[9] > 0 and rude[13] > 0
    assert len(f.of(b"")) == len(plain)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "you idiot " * 20000, "fine words", "fine"])] + [(None, "idiot", "y"), (3, "twice", "y")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scored(docs, none).collect()
    assert len(rows) == 7 and all(r.score == 0 for r in rows)
    many = spark.createDataFrame([(i, ("you idiot" if i % 3 == 0 else "calm words") + f" w{i}") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (5, None), (6, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(many, labels).collect()}
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in range(120)]) > 0.95
    assert toxicity.scored(many.limit(0), labels).count() == 0


def slow_features(f, text):
    """The same counts word by word, each by its definition."""
    words = ["".join(c if c.isalnum() and ord(c) < 128 or ord(c) >= 128 or c == "'" else " " for c in text)]
    words = "".join(c.lower() if ord(c) < 128 else c for c in words[0]).split()
    n = max(1, len(words))
    known, second = {w.decode() for w in f.known}, {w.decode() for w in f.second}
    weight = {w.decode(): v for w, v in f.learned.items()}
    hits = [i for i, w in enumerate(words) if w in known]
    near = sum(any(words[j] in second for j in range(max(0, i - 5), min(len(words), i + 6))) for i in hits)
    run = sum(i - j <= 30 for j, i in zip(hits, hits[1:]))
    fixed = sum(words[i] in {w.decode() for w in f.fixed} for i in hits)
    vs = [weight.get(words[i], 0.0) for i in hits]
    return [fixed / n, len(hits) / n, sum(vs) / n, max(vs, default=0.0), sum(v > 2 for v in vs) / n, float(len({words[i] for i in hits})), float(min(len(hits), 50)), near / n, run / n]


def test_features_match_a_slow_version(spark):
    f = toxicity.Features({"vile": 3.0, "meh": 1.5, "éa": 2.5})
    rng = np.random.default_rng(4)
    pool = ["you", "calm", "idiot", "Vile", "MEH!", "éa", "your", "x,y", "tu", "fine.", "It's", "scum", "1d"]
    for n in (0, 1, 5, 60, 2_000):
        text = " ".join(rng.choice(pool, n))
        assert np.allclose(f.of(text.encode())[:9], slow_features(f, text))
    texts = [" ".join(rng.choice(pool, 40)) for _ in range(1_200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f.column()(F.col("t")).alias("f")).orderBy("i").collect()
    assert all(np.allclose(r.f, f.of(texts[r.i].encode())) for r in got)


def test_long_texts_take_linear_time():
    f = toxicity.Features({"vile": 3.0})
    f.of(b"you idiot " * 1_000)
    took = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        f.of(b"you idiot " * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def test_one_class(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    for label in (0, 1):
        rows = toxicity.scored(docs, spark.createDataFrame([(i, label) for i in range(40)], "doc_id long, toxic int")).collect()
        assert {(r.score, r.predicted) for r in rows} == {(float(label), label)}


def test_long_text_with_a_model(spark):
    rows = [(i, ("you idiot" if i % 3 == 0 else "calm words") + f" w{i}") for i in range(120)] + [(500, "you idiot " * 60_000), (501, "calm words " * 60_000), (502, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[500].score > got[501].score and got[500].predicted == 1 and got[502].predicted == 0
