import numpy as np
import pytest

from refscan.llm import mixing
from tests.conftest import DATA


def projected(t, p, goal, steps=25, close=1e-4):
    """The same descent in numpy."""
    total, r = t.sum(), np.ones(len(t))
    overlap = np.linalg.pinv((p * t[:, None]).T @ p / total, rcond=1e-9)
    for _ in range(steps):
        at = (r * t) @ p
        if np.abs(at - goal).max() <= close * total:
            break
        r = np.maximum(0, r - p @ (overlap @ (at - goal) / total))
    return r


def test_targets_are_met_and_rates_match(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mixed(docs, mixing.label_domains(labels)).orderBy("doc_id").collect()
    assert len(rows) == docs.count()
    t, p = np.array([r.tokens for r in rows], float), np.array([[r.p_clean, r.p_low, r.p_toxic] for r in rows])
    assert np.allclose(p.sum(1), 1)
    words = {r.doc_id: len(r.text.replace("\n", " ").split(" ")) for r in docs.collect()}
    assert all(r.tokens <= words[r.doc_id] for r in rows)
    goal = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * t.sum()
    rates = np.array([r.rate for r in rows])
    assert (rates >= 0).all() and np.abs((rates * t) @ p - goal).max() <= 0.01 * t.sum()
    assert np.allclose(rates, projected(t, p, goal), atol=1e-6)
    truth = {r.doc_id: int(r.domain) for r in mixing.label_domains(labels).collect()}
    assert np.mean([p[i].argmax() == truth[r.doc_id] for i, r in enumerate(rows) if r.doc_id in truth]) > 0.85
    assert abs(np.mean([r.copies for r in rows]) - rates.mean()) < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", "b"), (3, "one\ntwo  three", "b"), (3, "again", "c"), (4, "w " * 20000, "c")], "doc_id long, text string, rate string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.mixed(docs, mixing.label_domains(none)).collect()
    assert sorted(r.tokens for r in rows) == [0, 0, 1, 2, 3, 20000] and all(abs(r.p_low - 1 / 3) < 1e-12 for r in rows)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, 1), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mixed(docs, mixing.label_domains(labels)).count() == 6
    assert mixing.mixed(docs.limit(0), mixing.label_domains(labels)).count() == 0
    same = mixing.resampled(docs, mixing.label_domains(none), {"clean": 1, "low": 1, "toxic": 1})
    assert same.columns == docs.columns and same.count() == 6


def test_anchored_targets_are_limits(spark):
    """A domain with less than its target is not repeated up to it; one with more comes down; the anchor's total stays."""
    rows = [(i, 100, [0.98, 0.01, 0.01]) for i in range(50)] + [(100 + i, 100, [0.02, 0.01, 0.97]) for i in range(10)] + [(200, 1, [0.05, 0.9, 0.05])]
    found = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    rated = mixing.fitted_rates(found, {"clean": 0.9, "low": 0.08, "toxic": 0.02}, anchor="clean").collect()
    t, p, rates = np.array([r.tokens for r in rated], float), np.array([r.p for r in rated]), np.array([r.rate for r in rated])
    before, after = t @ p, (rates * t) @ p
    goal = np.array([0.9, 0.08, 0.02]) * before[0] / 0.9
    assert goal[1] > before[1] >= after[1] and goal[2] < before[2]
    assert np.abs((after - goal)[[0, 2]]).max() < 0.01 * t.sum() and rates.max() < 1.2


def test_targets_out_of_reach_are_said(spark):
    found = spark.createDataFrame([(i, 10, [0.9, 0.05, 0.05]) for i in range(5)], "doc_id long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="targets are not met after 25 steps"):
        assert mixing.fitted_rates(found, {"clean": 0.2, "low": 0.4, "toxic": 0.4}).count() == 5
