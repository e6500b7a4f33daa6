import numpy as np
from pyspark.sql import functions as F

from refscan.llm import ann
from tests.conftest import DATA


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        score = (x * x[np.flatnonzero(ids == q)[0]]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df, q, **more):
    out = {}
    for r in ann.neighbours(df, q, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    for d in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"{DATA}/{d}/embeddings.parquet")
        frame = df.toPandas()
        ids, x = frame.vec_id.to_numpy(), np.stack(frame.embedding.to_numpy()).astype(float)
        want, got = brute(ids, x, ids[ids % 20 == 0]), found(df, F.col("vec_id") % 20 == 0)
        assert set(got) == set(want)
        hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
        assert np.mean(hits) >= 0.9
        scores = {(q, v): s for q in want for v, s in want[q]}
        assert all(abs(s - scores[q, v]) < 1e-12 for q in got for v, s in got[q] if (q, v) in scores)


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).tolist(), 1) for i in range(40)]
    rows += [(100 + i, [0.5, 0.5, 0.5], 1) for i in range(60)]  # one hot vector
    rows += [(200, None, 1), (220, [0.0, 0.0, 0.0], 1), (240, [1.0, None, 1.0], 1), (260, [1.0, float("nan"), 1.0], 1), (280, [1.0, float("inf"), 0.0], 1), (300, [1.0], 1), (None, [1.0, 1.0, 1.0], 1), (20, rows[20][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    good = [r for r in rows[:100]]
    ids, x = np.array([r[0] for r in good]), np.array([np.array(r[1], np.float32) for r in good], float)
    assert found(df, F.col("vec_id") % 20 == 0, recall=2) == brute(ids, x, [i for i in ids if i % 20 == 0])
    few = found(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert {q: len(v) for q, v in few.items()} == {0: 4}
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_search_of_all_leaves_is_exact():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    tree = ann.Tree(x)
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves))
    assert len(np.unique(tree.leaf_of(x))) > 1
    assert ann.Tree(np.ones((300, 4))).leaves == 1
