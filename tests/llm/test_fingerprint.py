import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from refscan.llm import fingerprint as fp
from tests.conftest import DATA

RANK = np.random.default_rng(3).permutation(fp.LEVELS)


def slow_levels(data):
    return [int(fp.level(np.array(fp.NLOGN[np.bincount(data[i : i + fp.WINDOW], minlength=256)].sum()))) for i in range(len(data) - fp.WINDOW + 1)]


def slow_selected(ranks):
    points = [0] * len(ranks)
    for i in range(1 - fp.RUN, len(ranks) if ranks else -fp.RUN):
        points[min(range(max(0, i), min(len(ranks), i + fp.RUN)), key=lambda j: (ranks[j], j))] += 1
    return [i for i, p in enumerate(points) if p >= fp.POINTS]


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=300), st.integers(2, 255))
def test_levels_and_selection(raw, kinds):
    data = np.frombuffer(raw, np.uint8) % kinds
    got = fp.window_levels(data.astype(np.uint8))
    assert got.tolist() == (slow_levels(data) if len(data) >= fp.WINDOW else [])
    assert fp.selected(RANK[got]).tolist() == slow_selected(RANK[got].tolist())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.text(max_size=400))
def test_edited_digest_equals_direct_one(a, b):
    d = fp.Digests(RANK.tolist())
    (_, mine, chain), (_, other, _) = d.of(a), d.of(b)
    new, kept, taken = fp.edited(a, b)
    direct = fp.digest(np.frombuffer(new.encode(), np.uint8), d.rank)
    assert fp.spelled(d.of_edited(new, kept, mine, other)) == fp.spelled(direct)
    assert fp.likeness(chain, chain) == 1 and 0 <= fp.likeness(chain, direct) <= 1
    assert (fp.spelled(chain) == "") == (a == "")


def test_every_text_has_features():
    d = fp.Digests(RANK.tolist())
    empty = d.of("")[2]
    for text in ("a" * 1000, "ab" * 800, "0123456789" * 200, " " * 5000, "é" * 400, "a", "é"):
        chain = d.of(text)[2]
        assert chain and fp.likeness(chain, empty) == 0 and fp.likeness(chain, chain) == 1
    assert fp.spelled(d.of("a")[2]) != fp.spelled(d.of("b")[2])


def test_lengths_compare_alike():
    """Edited texts that are shorter than the text, across all sizes of some hundred bytes."""
    rng = np.random.default_rng(2)
    d = fp.Digests(list(range(fp.LEVELS)))
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(400)]
    near = []
    for n in range(100, 400, 3):
        text = " ".join(rng.choice(words, 120))[:n]
        (_, mine, chain), (_, other, _) = d.of(text), d.of("")
        new, kept, _ = fp.edited(text, "")
        near.append(fp.likeness(chain, d.of_edited(new, kept, mine, other)))
    assert min(near) > 0.7 and np.median(near) > 0.95  # what is left is all contained in the text


def test_ranges_split_equal_ids():
    r = fp.Ranges(np.array([3, 7, 7, 7, 9]))
    order = np.array([1, 3, 4, 7, 7, 7, 8, 9, 10])
    hashed = np.array([0, 5, 0, -(1 << 63), 0, (1 << 63) - 1, 0, 1 << 62, 0])
    got = r.of(order, hashed)
    assert got.tolist() == sorted(got.tolist()) and got[3] == 1 and got[5] == 4 and got[0] == 0 and got[-1] == 5


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    by_text, better = {}, 0
    for i, r in enumerate(rows):
        g, following = got[r.doc_id], rows[(i + 1) % len(rows)].text
        n = len(r.text) // 3
        new = r.text[: len(r.text) - n] + following[:n]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(new.encode()).hexdigest())
        assert by_text.setdefault(r.text, g.fingerprint) == g.fingerprint
        better += g.near_edited > g.near_next
        if r.text == following:
            assert g.near_next == 1
    assert better >= 0.97 * len(rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(3, None, 1), (2, "", 1), (2, "b" * 50, 1), (1, "é" * 400, 1), (None, "x", 1), (0, "short", 2)], "doc_id long, text string, range int")
    got = {(r.doc_id, r.n_chars): r for r in fp.fingerprints(docs).collect()}
    assert set(got) == {(3, 0), (2, 0), (2, 50), (1, 400), (None, 1), (0, 5)}
    assert got[3, 0].fingerprint == "" and got[3, 0].near_next == 1.0
    assert got[0, 5].edited_sha256 == hashlib.sha256(b"shorx").hexdigest()  # nulls come last
    assert got[None, 1].edited_sha256 == hashlib.sha256(b"x").hexdigest()
    one = fp.fingerprints(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(("é" * 400).encode()).hexdigest()
    assert fp.fingerprints(docs.limit(0)).count() == 0


def test_many_null_ids_and_a_long_text(spark):
    rows = [(None, f"text {i % 50} of many") for i in range(400)] + [(5, "word " * 60_000), (4, "tail")]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 402 and all(r.fingerprint for r in got)
    long = next(r for r in got if r.doc_id == 5)
    assert long.n_chars == 300_000 and long.edited_sha256 == hashlib.sha256(("word " * 40_000 + "tail").encode()).hexdigest()
    # equal texts follow each other, so most are followed by their like
    assert sum(r.near_next == 1 for r in got) >= 340
