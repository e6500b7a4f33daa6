"""Periodic runs of words, after Main and Lorentz.

A text's words are interned as small numbers. Its positions are halved again and again; of each midpoint the
Z-function of what follows it, and of what precedes it read backwards, tells which periods repeat right there: a run of
four or more periods that crosses a midpoint has two of them on one side. What is found is extended to both sides
until words differ. Larger blocks come first, so a run is extended once: smaller midpoints within it find it done.
Of a stretch's periods only the smallest is extended, as its multiples are seen to lie within it.

All blocks of a level, of many texts at once, are compared word by word for the first words of their Z-functions, which
settles nearly all positions; blocks in which longer stretches agree get the linear algorithm. So the work is that of
n log n words, also for texts that are one word again and again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, texts_of

#: A run has so many periods, and so many words, at least. Fewer than four periods may have less than two on either side of a midpoint.
POWER, SHORTEST = 4, 6
#: Words that all blocks of a level are compared for at once.
STEPS = 16
#: Bytes of a text that are words as objects at a time.
PIECE = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"

Run = tuple[int, int, int]  # start, length, period


class Interned(dict):
    """Numbers of words, in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, text: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end] not in BLANKS:
                end += 1
            parts.append(np.array(list(map(self.__getitem__, text[at:end].split())), np.int32))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.int32)


def z_function(ids: list[int]) -> list[int]:
    """For each place, how many words from there are those that the list begins with."""
    n = len(ids)
    out = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        z = min(right - i, out[i - left]) if i < right else 0
        while i + z < n and ids[z] == ids[i + z]:
            z += 1
        if i + z > right:
            left, right = i, i + z
        out[i] = z
    return out


def repeated_at(ids: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places ``at`` that lie a period after their midpoint (before it, if ``step`` is -1): which have z-values of a period or
    more, as far as STEPS words tell, and which aren't settled by then."""
    live, done = np.arange(len(at)), []
    for k in range(STEPS):
        here = at[live] + step * k
        live = live[ids[here] == ids[here - step * period[live]]]
        if not len(live):
            break
        ends = period[live] == k + 1
        done.append(live[ends])
        live = live[~ends]
    found = np.concatenate(done) if done else np.empty(0, np.int64)
    return at[found], period[found], live


def squares(ids: np.ndarray, ends: np.ndarray, half: int, place: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """By midpoint: periods that repeat at once, two of them, after it (from its first word on, 1) or before it (up to its last word, -1).

    For the midpoints of blocks of 2 x ``half`` words. ids: the words of several texts; place: of a word in its text; ends: where its text ends."""
    inner, right = place & (half - 1), (place & half) > 0
    longest = max(1, half // 2)
    # After the midpoint: the place is a period behind it, and another period fits before the text ends.
    after = np.flatnonzero(right & (inner >= 1) & (inner <= longest))
    after = after[after + inner[after] <= ends[after]]
    # Before it: the place is a period from the last word there; the midpoint itself has to lie in the text.
    back = half - 1 - inner
    before = np.flatnonzero(~right & (back >= 1) & (back <= longest))
    before = before[before + back[before] + 1 < ends[before]]
    out = defaultdict(list)
    for step, at, period in ((1, after, inner[after]), (-1, before, back[before])):
        found, q, open_ = repeated_at(ids, at, period, step)
        for middle, n in zip((found - step * q).tolist(), q.tolist(), strict=True):
            out[step, middle].append(n)
        for middle in np.unique(at[open_] - step * period[open_]).tolist():
            span = ids[middle : min(middle + half, int(ends[middle]))] if step > 0 else ids[middle - half + 1 : middle + 1][::-1]
            z = np.array(z_function(span.tolist()))
            q = np.arange(len(z))
            out[step, middle] += q[(z >= q) & (q > STEPS) & (q <= longest)].tolist()
    return out


def same_after(ids: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from j (before ``end``) are those from i."""
    n, size = 0, 32
    while j + n < end:
        size = min(size, end - j - n)
        differ = ids[i + n : i + n + size] != ids[j + n : j + n + size]
        if differ.any():
            return n + int(differ.argmax())
        n, size = n + size, size * 2
    return n


def same_before(ids: np.ndarray, i: int, j: int, begin: int) -> int:
    """How many words before i (from ``begin`` on) are those before j."""
    n, size = 0, 32
    while i - n > begin:
        size = min(size, i - n - begin)
        differ = ids[i - n - size : i - n] != ids[j - n - size : j - n]
        if differ.any():
            return n + int(differ[::-1].argmax())
        n, size = n + size, size * 2
    return n


def runs_of(texts: list[np.ndarray], power: int = POWER, shortest: int = SHORTEST) -> list[list[Run]]:
    """The runs of each text, given as word numbers: by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # texts that a level of blocks concerns stand in front
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    last = np.cumsum(sizes)
    first = last - sizes
    total = int(last[-1]) if len(last) else 0
    out: list[list[Run]] = [[] for _ in texts]
    if not total:
        return out
    ids = np.concatenate([texts[i] for i in order])
    place, ends = np.arange(total) - np.repeat(first, sizes), np.repeat(last, sizes)
    found: dict[tuple[int, int], tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))  # by text's end and period: where runs start and end
    half = 1 << int(sizes[0]).bit_length()
    while half > 1:
        half //= 2
        n = int(np.searchsorted(-sizes, -half))  # texts longer than half a block
        for (step, middle), periods in squares(ids[: last[n - 1]], ends[: last[n - 1]], half, place[: last[n - 1]]).items() if n else ():
            seen = []
            for q in sorted(periods):
                start = middle if step > 0 else middle - 2 * q + 1
                if seen and any(q % p == 0 and lo <= start and hi >= start + 2 * q for p, lo, hi in seen):
                    continue
                end = int(ends[start])
                starts, stops = found[end, q]
                i = bisect_right(starts, start) - 1
                if i < 0 or stops[i] < start + 2 * q:
                    lo = start - same_before(ids, start, start + q, end - int(sizes[np.searchsorted(last, end)]))
                    i = bisect_left(starts, lo)
                    starts.insert(i, lo)
                    stops.insert(i, start + 2 * q + same_after(ids, start + q, start + 2 * q, end))
                seen.append((q, starts[i], stops[i]))
    of_end = {int(e): n for n, (e, s) in enumerate(zip(last, sizes, strict=True)) if s}
    for (end, q), (starts, stops) in found.items():
        n = of_end[end]
        out[order[n]] += [(lo - int(first[n]), hi - lo, q) for lo, hi in zip(starts, stops, strict=True) if hi - lo >= max(shortest, power * q)]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(ids: np.ndarray, runs: list[Run]) -> np.ndarray:
    """The words without those that a run holds after its first period."""
    if not runs:
        return ids
    keep = np.ones(len(ids), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return ids[keep]


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("text", pa.string())])


def periodic_runs(docs: DataFrame, power: int = POWER, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and text, collapsed: a row for each row of ``docs``.

    Words are what stands between blanks and other ASCII space. A run is a stretch of words with a smallest period, of
    ``power`` (four or more) periods and ``shortest`` words or more, that no neighbouring word extends. The collapsed text keeps
    a run's first period: words that any run holds behind its first are dropped, the others are joined by one
    space. Null and empty texts have no words, no runs and an empty text; rows with repeated or null ids are
    each taken by themselves; other columns are ignored; an empty table gives an empty result. Very long texts are taken
    whole: a task holds four numbers for each word of a text, and its distinct words."""
    if power < 4:
        raise ValueError("power must be four or more: shorter runs may have less than two periods on either side of a midpoint")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = 0
            for texts in texts_of(batch["text"]):
                known = Interned()
                ids = [known.of(t) for t in texts]
                words = list(known)
                runs = runs_of(ids, power, shortest)
                rest = [b" ".join([words[i] for i in collapsed(x, r).tolist()]) for x, r in zip(ids, runs, strict=True)]
                own = batch["doc_id"].slice(at, len(texts))
                at += len(texts)
                spans = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays([own, pa.array([len(x) for x in ids], pa.int64()), pa.array(spans, OUT.field("runs").type), pa.array(rest, pa.binary()).cast(pa.string())], schema=OUT)

    return id_and_text(docs).mapInArrow(found, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def looped(text: Column, doc_id: Column) -> Column:
    """A text for which crc32 of its id is divisible by ten, with words repeated from a place on, in a period, that the rest of
    the crc chooses; the others, and those without an id, stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        i = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i))
        return F.array_join(F.transform(i, lambda x: F.element_at(w, (x + 1).cast("int"))), " ")

    once = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))[0]  # the words are split once
    return F.when(F.pmod(h, F.lit(10)) == 0, once).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    """The runs of ``looped`` texts: doc_id, n_runs, the run of most periods (start, length, period, exponent_milli), and digests of all runs and of the collapsed text."""
    text = F.coalesce("text", F.lit(""))
    found = periodic_runs(docs.select("doc_id", looped(text, F.col("doc_id").cast("long")).alias("text")))
    # Of a and b, the one with more periods for its length; of equal ones the first, as runs come by start and period.
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate("runs", F.col("runs")[0], lambda a, b: F.when(more(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("text")).alias("collapsed_sha256"))
