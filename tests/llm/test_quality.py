import numpy as np

from refscan.llm import quality
from tests.conftest import DATA


def auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return np.mean((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None]))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.9
    assert (rows.predicted == (rows.score >= 0.3)).all() and (rows.predicted == rows.quality).mean() > 0.9


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [(rng.normal(size=(n, quality.FEATURES)).astype(np.float32), float(n % 2)) for n in (1, 3, 2, 5)]
    model = quality.fitted(bags, epochs=1)
    x, counts, y = np.concatenate([b for b, _ in bags]), np.array([len(b) for b, _ in bags]), np.array([v for _, v in bags])
    _, g = model.gradients(x, counts, y, 0.0)
    for name, value in list(model.weights.items()):
        at = tuple(0 for _ in value.shape)
        step, old = 1e-5, np.array(value, float)
        losses = []
        for sign in (1, -1):
            moved = old.copy()
            moved[at] += sign * step
            model.weights[name] = moved
            losses.append(model.gradients(x, counts, y, 0.0)[0])
        model.weights[name] = old
        assert abs((losses[0] - losses[1]) / (2 * step) - np.asarray(g[name])[at]) < 1e-5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "some words", "r"), (3, "JUNK!! " * 30000, "r"), (3, "again", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 1 for r in quality.scored(docs, labels.limit(0)).collect())
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns


def test_passages_cover_whole_texts():
    text = b" ".join(b"w%d" % i for i in range(1000))
    assert [w for p in quality.passages(text) for w in p] == text.split()
    x, counts = quality.encoded([text, b"", b"a b"])
    assert counts.tolist() == [16, 1, 1] and x.shape == (18, quality.FEATURES)


def test_training_is_bounded_by_bytes(spark):
    """Longer texts, fewer of them: what comes to the driver stays within the bound in expectation."""
    rows = [(i, f"w{i} " * 2_000) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    every = quality.training_bags(docs, labels, 300, 10**9)
    few = quality.training_bags(docs, labels, 300, 400_000)
    assert len(every) > 200 and 10 < len(few) < 90
