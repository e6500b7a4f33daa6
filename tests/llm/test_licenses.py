import re

import numpy as np

from refscan.llm import licenses
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def compared(docs):
    texts = sorted((r.doc_id or -1, r.text) for r in docs.select("doc_id", "text").collect())
    rows = sorted(licenses.scanned(docs).collect(), key=lambda r: r.doc_id or -1)
    for (_, text), r in zip(texts, rows, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    return {r.doc_id: r for r in rows}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = compared(docs)
    assert any("mit-short" in r.labels for r in rows.values()) and any("cc-by-nc" in r.labels for r in rows.values())


def test_templates_and_odd_rows(spark):
    notice, bsd = licenses.TEMPLATES["gpl-notice"][0], licenses.TEMPLATES["bsd"][0]
    edited = bsd.replace("source code must", "source must").replace("this list", "the list")
    texts = [None, "", "MIT license MIT License x mit LICENSE", "prefix words " + notice + " suffix", "noise " * 5000 + edited, bsd.replace("Redistribution and use", "Use"), " ".join(sorted(bsd.split())), "Ümit license; ﬁMIT\x7flicense", "general public", "licensed under cc by nc 4 0"]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = compared(docs)
    assert got[2].n_base == 3 and got[2].last_word == 5
    assert {"gpl", "gpl-notice"} <= set(got[3].labels.split(",")) and got[4].labels == "bsd" and got[4].score > 0.9
    assert got[5].labels == "" and got[6].labels == "" and got[9].labels == "cc-by-nc"
    assert licenses.scanned(docs.limit(0)).count() == 0


def slow_templates(index, words):
    """Templates by trying every place for each."""
    out = {}
    for name, template in index.words.items():
        for at in range(-licenses.DRIFT - len(template), len(words) + 1):
            share = index.compared(name, words, at) if at + len(template) + licenses.DRIFT > 0 else 0.0
            if share >= licenses.SHARE:
                out[name] = max(out.get(name, 0), share)
    return out


def test_templates_match_a_slow_version():
    """Edited licence texts in other words: the lookup of rare words loses nothing that comparing every place finds near them."""
    rng = np.random.default_rng(6)
    vocab = licenses.vocabulary()
    index = licenses.Index({w: int(rng.integers(0, 1_000)) for w in vocab})
    found = 0
    for name, (text, _) in licenses.TEMPLATES.items():
        for edits in range(0, 7):
            words = licenses.words_of(text.encode())
            for _ in range(edits):
                at = rng.integers(0, len(words))
                words[at] = [b"edited", rng.choice(vocab).encode(), words[at]][rng.integers(0, 3)]
            around = [f"w{i}".encode() for i in range(9)]
            file = [*around, *words, *around[::-1], *rng.choice(vocab, 5).astype(bytes)]
            labels, score = index.templates(file, set(file))
            want = slow_templates(index, file)
            assert labels == set(want) and abs(score - max(want.values(), default=0.0)) < 1e-12, (name, edits)
            found += name in labels
    assert found > 50


def test_common_variants_are_found():
    """Words that no file has are the rarest of all; a file without them is found all the same."""
    text, _ = licenses.TEMPLATES["isc"]
    words = [w for w in licenses.words_of(text.encode()) if w not in (b"notice", b"appear", b"copies")]
    frequency = {w: 0 if w in ("notice", "appear", "copies") else 1_000 for w in licenses.vocabulary()}
    assert "isc" in licenses.Index(frequency).templates(words, set(words))[0]
