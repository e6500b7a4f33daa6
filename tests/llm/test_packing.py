import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refscan.llm import packing
from tests.conftest import DATA


def full(ids, tok):
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in ids]


def valid(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for got in bins.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = packing.best_fit(docs).collect()
    source = docs.select("doc_id", "text").collect()
    tok, want = tokenizer(), {}
    for d, ids in zip(source, full([d.text for d in source], tok), strict=True):
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d.doc_id, i] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert valid(rows) <= math.ceil(sum(r.length for r in rows) / 2048 * 1.01) + 1


def test_odd_texts(spark):
    texts = ["", None, "x", "İstanbul ΑΣ. ΟΔΥΣΣΕΥΣ", "é ́e", "a\x1cb　c d\te\r\nf", "<|endoftext|> <|startoftext|>x", "it's we'll 1234 %%%&&&", "😀👍🏽 नमस्ते", "a" * 9000, "word " * 5000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, "", "z"), (None, "y", "z")], "doc_id long, text string, length string")
    rows = packing.best_fit(docs).collect()
    valid(rows)
    tok = tokenizer()
    want = Counter()
    for d in docs.collect():
        ids = full([d.text], tok)[0]
        want.update((d.doc_id, i, at, zlib.crc32(ids[at : at + 2048].tobytes())) for i, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in rows) == want
    assert packing.best_fit(docs.limit(0)).count() == 0


MARKS = ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "<|endoftext|", "<|", "|>", "<||>"]
PIECES = [*MARKS, "a", "B", " ", "  ", "\n", "É", "ß", "ÿ", "İ", "'s", "'LL", "12", "x.", "!", "...", "\t", "\xa0", "word", "Word,", "é", "e\u0301", "日本", "😀", "µ", "ª"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join), min_size=1, max_size=30))
def test_parts_give_the_tokenizers_ids(texts):
    """Marks in any case, next to anything: the ids of the parts are those of the text."""
    ids, tok = known(), plain_tokenizer()
    for text in texts:
        parts, latin = packing.parted(text)
        ids.learn({p for p in parts if p not in ids}, latin)
        got = b"".join(ids[p] for p in parts)
        assert got == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@cache
def known():
    return packing.WordIds(packing.tokenizer_path())


@cache
def plain_tokenizer():
    return tokenizer()


def spread(plan, counts, capacity):
    bins, seen = defaultdict(list), defaultdict(set)
    for size, lo, hi, first, offset in plan:
        for rank in range(lo, hi):
            bins[first + rank - lo].append((offset, size))
            assert rank not in seen[size]
            seen[size].add(rank)
    assert {s: len(x) for s, x in seen.items()} == {s: n for s, n in counts.items() if n}
    for got in bins.values():
        at = 0
        for offset, size in sorted(got):
            assert offset == at
            at += size
        assert at <= capacity
    return len(bins)


def fewest(items, capacity):
    """Fewest bins by full search."""
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                put(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_plan(items):
    counts = Counter(items)
    n = spread(packing.packed(counts, 20), counts, 20)
    assert n <= fewest(sorted(items, reverse=True), 20) * 11 / 9 + 1


@pytest.mark.parametrize("scale", [1, 1000])
def test_plan_size_is_bounded_by_capacity(scale):
    rng = np.random.default_rng(2)
    counts = {int(s): int(n) * scale for s, n in Counter(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1)).items()}
    plan = packing.packed(counts, 2048)
    assert len(plan) < 20 * 2048
    tokens = sum(s * n for s, n in counts.items())
    assert max(first + hi - lo for _, lo, hi, first, _ in plan) <= 1.01 * tokens / 2048 + 1
