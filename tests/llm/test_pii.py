import hashlib
import re

import numpy as np

from refscan.llm import pii
from tests.conftest import DATA

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def valid(kind, m):
    figures = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(figures) <= 19 and luhn(figures)
    return kind == "email" or 9 <= len(figures) <= 15


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def compared(docs):
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in pii.redactions(docs).collect()}
    for doc_id, text in texts:
        want, r = base(text), rows[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, want, r.spans)
        counts = [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        keys = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys)
        assert all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(text) for s in spans)
    return rows


def test_whole_table(spark):
    rows = compared(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))
    assert sum("secret" in r.spans for r in rows.values()) > 3


def test_odd_texts(spark):
    texts = [
        None, "", "a@b.c_d@e.f", "x.y@z-1.co.uk. q@", "@a.b", "1.2.3.4.5.6.7.8", "300.1.1.1 001.002.003.004 0000000000000255.1.1.1 99999999999999999999.1.1.1",
        "é😀 4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 4111111111111111", "+1 (555) 123-4567 +12 +123456789012345678 + 1234567890", "+1.2.3.4 555@a.b +1@c.d",
        "9" * 30000, "a" * 30000 + "@b.c", "1." * 20000, "a.b" * 5000 + "@" + "c.d" * 5000, "5 " * 20000, "+" + "(1" * 9000, "token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\"", "a\n1.1.1.1\n2.2.2.2 ", "0-0 0-0-0 0-0 0-0 0-0 0",
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    compared(docs)
    assert pii.redactions(docs.limit(0)).count() == 0
    out = {r.doc_id: r.text for r in pii.redacted(docs.where("doc_id IN (0, 7, 18)")).collect()}
    assert out[7].startswith("é😀 [CARD] and") and out[18] == "a\n[IP]\n[IP] " and out[0] == ""


def planted(n=400):
    """Texts with base spans, wrong numbers and addresses, tokens after telling, other and no names; and spans that a reader would add."""
    rng, rows, secrets, unknown, wrong = np.random.default_rng(1), [], [], [], []
    hexes = lambda k: "".join(rng.choice(list("0123456789abcdef"), k)) + "0a"
    for i in range(n):
        area, line = rng.integers(100, 999), rng.integers(1000, 9999)
        parts = [
            f"mail to user{i}@host{i % 7}.example.com or call +1 ({area}) 555-{line} now", f"version number {rng.integers(10**15, 10**16)} and host 10.{i % 250}.3.4", f"ping me at user{i}@localhost today, build {i % 9}00.1.2.{i}",
            f'key = "{hexes(40)}"', f"commit {hexes(40)} was fine", f"plain words number {i} and more of them",
        ]
        extra = {0: f'sesame = "{hexes(40)}"', 1: f"write user{i} (at) host{i % 7} (dot) com soon", 2: f"my number ({area}) 555-{line} at home"}.get(i % 5)
        text = " . ".join(rng.permutation([*parts, *([extra] if extra else [])]))
        rows.append((i, text))
        at = text.index('key = "') + 7
        secrets.append((i, f"secret:{at}:{at + 42}"))
        at = text.index("commit ") + 7
        wrong.append((i, f"secret:{at}:{at + 42}"))
        if extra:
            inner = re.search(r'"(.*)"|user.*com|\(.*\d', extra)
            inner = inner[1] or inner[0]
            at = text.index(extra) + extra.index(inner)
            unknown.append((i, {0: "secret", 1: "email", 2: "phone"}[i % 5] + f":{at}:{at + len(inner)}"))
    return rows, secrets, unknown, wrong


def test_planted_data_is_found(spark):
    rows, secrets, unknown, wrong = planted()
    found = {r.doc_id: set(r.spans.split(",")) for r in compared(spark.createDataFrame(rows, "doc_id long, text string")).values()}
    share = lambda spans: np.mean([s in found[i] for i, s in spans])
    assert share(secrets) > 0.95 and share(wrong) == 0
    assert share(unknown) > 0.6  # of kinds whose truth the trees never saw
    text = dict(rows)
    right = {(i, s) for i, s in (*secrets, *unknown)} | {(i, s) for i, t in rows for s in base(t)}
    added = [(i, s) for i, spans in found.items() for s in spans]
    assert np.mean([x in right for x in added]) > 0.9, [text[i][int(s.split(":")[1]) : int(s.split(":")[2])] for i, s in added if (i, s) not in right][:5]


def test_many_spans_of_one_text(spark):
    """Places of thousands of spans, with their order and sums."""
    text = " ".join(f"u{i}@h.example.com 10.0.{i % 256}.1 é" for i in range(3_000))
    rows = compared(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert (rows[1].n_email, rows[1].n_ip, rows[1].n_spans) == (3_000, 3_000, 6_000)
