import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from refscan.llm import runs
from tests.conftest import DATA


def brute(words, power=4, shortest=6):
    """All runs by trying each period at each place."""
    n, out = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, power * q):
                out.setdefault((i, j + q - i), q)  # a smaller period came first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The query's row, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = None
    for s, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    start, length, period = best or (None, None, None)
    return (doc_id, len(found), start, length, period, 1000 * length // period if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_of_random_words():
    rng = random.Random(1)
    for alphabet in (1, 2, 3, 5):
        texts = [[rng.randrange(alphabet) for _ in range(rng.randrange(80))] for _ in range(120)]
        for _ in range(120):  # repeated parts within others
            text = [rng.randrange(alphabet + 3) for _ in range(rng.randrange(30))]
            for _ in range(rng.randrange(1, 5)):
                part = [rng.randrange(alphabet + 1) for _ in range(rng.randrange(1, 40))]
                text += (part * rng.randrange(1, 9))[: rng.randrange(1, 300)] + [rng.randrange(alphabet)]
            texts.append(text)
        got = runs.runs_of([np.array(t, np.int32) for t in texts])
        assert got == [brute(t) for t in texts]
    assert sum(map(len, got)) > 100


def test_long_runs_take_linear_time():
    n = 300_000
    assert runs.runs_of([np.zeros(n, np.int32)]) == [[(0, n, 1)]]
    part = np.random.default_rng(0).integers(0, 1000, 40)
    text = np.concatenate([np.arange(1000, 1010), np.tile(part, n // 40), [5000]]).astype(np.int32)
    start, length, period = runs.runs_of([text])[0][0]
    assert (start, period) == (10, 40) and length >= n - 40
    assert runs.runs_of([]) == [] and runs.runs_of([np.empty(0, np.int32)]) == [[]]


def test_z_function():
    assert runs.z_function(list("aabaab")) == [6, 1, 0, 3, 1, 0] and runs.z_function([1]) == [1]


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r) for r in runs.query(docs).collect()}
    want = {r.doc_id: expected(r.doc_id, r.text) for r in docs.collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 5


def test_odd_rows(spark):
    looped = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    plain = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 3)
    texts = [None, "", " \n", "a", "a " * 9, "x " + "a b " * 5 + "a", "é é " * 4 + "\x00 \x00\t\x0b\x0c\r", "w " * 50_000, "one two three four five six"]
    rows = [(i, t, 1, "s") for i in (looped, plain, None) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, start string")
    got = sorted(map(tuple, runs.query(df).collect()), key=repr)
    fixed = lambda t: "w " * 50_000 if t == texts[7] else t
    want = []
    for i, t, _, _ in rows:
        if t == texts[7] and i != looped:  # one word again and again: by hand
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            want.append((i, 1, 0, 50_000, 1, 50_000_000, sha("0,50000,1\n"), sha("w")))
        elif t == texts[7]:
            want.append((i, 1, 0, 50_000, 1, 50_000_000, hashlib.sha256(b"0,50000,1\n").hexdigest(), hashlib.sha256(b"w").hexdigest()))
        else:
            want.append(expected(i, fixed(t)))
    assert got == sorted(want, key=repr)
    assert runs.query(df.limit(0)).count() == 0
    kept = runs.periodic_runs(df.where("doc_id = %d AND text LIKE 'x %%'" % plain)).first()
    assert (kept.n_words, kept.text, [tuple(r) for r in kept.runs]) == (12, "x a b", [(1, 11, 2)])
    with pytest.raises(ValueError, match="four"):
        runs.periodic_runs(df, power=3)
