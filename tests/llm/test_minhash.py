import numpy as np
import pandas as pd
import pytest

from refscan.llm import minhash
from tests.conftest import DATA


def sets_of(texts, width):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def brute(rows, width):
    """Smallest reachable id of each row, by comparing all pairs."""
    ids, sets = [r[0] for r in rows], sets_of([r[1] for r in rows], width)
    label = dict(zip(ids, ids, strict=True))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(ids[i]), root(ids[j])))
                label[b] = a
    return {i: root(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets, strict=True)}


def compared(found, rows, width):
    want, sizes = brute(rows, width)
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.component_id, r.n_shingles, r.kept) == (want[i], sizes[i], want[i] == i)


@pytest.mark.parametrize("width", [4, 5])
def test_whole_table(spark, width):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compared(minhash.near_duplicates(docs, width=width), rows, width)


@pytest.mark.parametrize("words", [40, 300])
def test_large_group_of_edited_copies(spark, words):
    """Long lists: copies with few to many edits, so that some links don't touch the original."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, words)]
    texts = {}
    for i in range(160):
        copy = list(base)
        for at in rng.integers(0, words, rng.integers(0, words // 18)):
            copy[at] = f"e{rng.integers(0, 30)}"
        texts[i] = " ".join(copy)
        if i % 8 == 0:  # a copy with an edit of its own is linked to its source alone
            texts[1000 + i] = texts[i] + " tail"
    rows = list(texts.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared(minhash.near_duplicates(docs, width=4), rows, 4)


def test_odd_rows(spark):
    rows = [(1, "a b c d e", "x"), (2, "A B c  d\te", "x"), (3, "", None), (4, None, None), (5, " \n", "y"), (6, "a b", "y"), (7, "A\nb", "y"), (8, "a b é", None), (9, "a b É", None), (None, "a b c d e", None), (1, "a b c d e", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").withColumnsRenamed({"n": "component"}).selectExpr("*", "doc_id as n", "text as sig")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width=4).collect())
    assert [g[0] for g in got] == [-1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    by = {g[0]: g[1:] for g in got}
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[-1] == (2, None, True)
    assert by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (0, 5, True)
    assert by[6] == (1, 6, True) and by[7] == (1, 6, False) and by[8] == (1, 8, True) and by[9] == (1, 9, True)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_agree_with_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50)) for _ in range(30)]
    frame = pd.DataFrame({"node": range(30), "component": [0] * 10 + list(range(10, 30)), "set": sets})
    got = set(map(tuple, minhash.linked_blocks(frame[10:], frame, 60).to_numpy()))
    want = {(i, j) for i in range(10, 30) for j in range(30) if frame.component[i] != frame.component[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert got == want


@pytest.mark.parametrize("longer", [70, 80, 100, 150])
def test_truncated_copies(spark, longer):
    """Copies that lack the end, at similarities from just below 0.80 to 0.85: sketches of such sizes reach beyond 2^63."""
    rng = np.random.default_rng(longer)
    rows = []
    for i in range(60):
        words = [f"g{i}w{x}" for x in rng.integers(0, 10**9, longer + 4)]
        cut = int(np.ceil((0.79 + 0.06 * rng.random()) * longer)) + 4
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:cut]))]
    compared(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5), rows, 5)


def test_ids_with_several_texts(spark):
    """A repeated id has the links of all its texts: compared with all pairs of (id, text)."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    a, b = word(30), word(30)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    texts = [word(40) for _ in range(20)]
    rows = [(int(rng.integers(0, 40)), " ".join([*texts[rng.integers(0, 20)], *word(rng.integers(0, 3))])) for _ in range(70)]
    label = {i: i for i, _ in rows}
    sets = sets_of([t for _, t in rows], 5)
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if rows[i][0] == rows[j][0] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[rows[i][0]] = label[rows[j][0]] = min(label[rows[i][0]], label[rows[j][0]])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == label[r.doc_id] for r in got)


def test_without_near_duplicates(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 1), (None, "a b c d e f", 2), (3, None, 3), (4, long, 4), (5, long + " tail", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone_id int").selectExpr("*", "7 as component_id", "8 as node")
    out = minhash.without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r._gone_id, r.component_id) for r in out.collect()) == [(0, 2, 7), (1, 1, 7), (3, 3, 7), (4, 4, 7)]
    assert minhash.without_near_duplicates(docs.limit(0)).count() == 0
