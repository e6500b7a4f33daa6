"""Document fingerprints: improbable-feature digests.

Every byte window of a text has an entropy; its rarity rank is how few of the corpus's windows have an
entropy like it (a histogram over all windows of all texts). Of each run of windows the rarest, the
leftmost of equals, gains a point; windows with enough points are the text's selected features. Runs reach over
both ends of a text, so the rarest window of any text, however short, has all the points there are. The
features' hashes go, in order, into a chain of Bloom filters. Two digests are compared filter by filter: the
overlap in bits, normalised between what chance gives and the most that is possible, best match each,
averaged by the number of features.

A text that is shorter than a window is filled up to one with bytes that no text has.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, texts_of

WINDOW, RUN, POINTS = 16, 16, 4  # bytes of a window; windows of a run; points that select
BITS, HASHES, MOST = 2048, 5, 192  # of one filter: bits, bits set by a feature, features
LEVELS = 64  # of entropy

_N = np.arange(WINDOW + 1)
#: n * log2 n in units of 2^-16, so sums are exact.
NLOGN = np.round(np.where(_N > 0, _N * np.log2(np.maximum(_N, 1)), 0) * 65536).astype(np.int64)
TOP = int(NLOGN[WINDOW])


def level(total: np.ndarray) -> np.ndarray:
    """Entropy level, from 0 to LEVELS - 1, of windows with the given sum of n log n."""
    return (TOP - total) * LEVELS // (TOP + 1)


def filled(data: np.ndarray) -> np.ndarray:
    """The bytes of a text that isn't empty, at least a window of them."""
    return np.concatenate([data, np.full(WINDOW - len(data), 255, np.uint8)]) if 0 < len(data) < WINDOW else data


def window_levels(data: np.ndarray) -> np.ndarray:
    """Levels of all windows of ``data``, one for each byte they start at."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    # Equal bytes next to each other, in order: ranks of positions among equal bytes.
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (4 * n) + order
    place = np.arange(n)
    behind, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    behind[order] = place - np.searchsorted(key, key - (WINDOW - 1), "left")  # equal bytes among the WINDOW - 1 before
    ahead[order] = np.searchsorted(key, key + (WINDOW - 1), "right") - 1 - place  # and after
    first = int(NLOGN[np.bincount(data[:WINDOW], minlength=256)].sum())
    gone, come = ahead[: n - WINDOW], behind[WINDOW:]
    change = NLOGN[come + 1] - NLOGN[come] - NLOGN[gone + 1] + NLOGN[gone]
    return level(np.concatenate([[first], first + np.cumsum(change)]))


def selected(ranks: np.ndarray) -> np.ndarray:
    """Starts of the windows with POINTS points: each run of RUN windows, and each part of one at an end, gives one to its rarest."""
    if not len(ranks):
        return np.empty(0, np.int64)
    beyond = np.full(RUN - 1, 1 << 62)
    least = np.concatenate([beyond, ranks * (1 << 40) + np.arange(len(ranks)), beyond])
    width = 1
    while width < RUN:  # minimum of each run, by doubling
        step = min(width, RUN - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return np.flatnonzero(np.bincount(least & ((1 << 40) - 1), minlength=len(ranks)) >= POINTS)


def hashes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the windows of ``data`` (width: a multiple of 8) at ``starts``."""
    words = np.ascontiguousarray(data[starts[:, None] + np.arange(width)]).view(np.uint64)
    out = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        out = (out ^ words[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xC4CEB9FE1A85EC53)


def digest(data: np.ndarray, rank: np.ndarray, levels: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """The chain of (features, filter as bytes) of a text's bytes; empty for an empty text alone."""
    data = filled(data)
    starts = selected(rank[window_levels(data) if levels is None else levels])
    found = hashes(data, starts, WINDOW)
    _, first = np.unique(found, return_index=True)
    found = found[np.sort(first)]
    chain = []
    for at in range(0, len(found), MOST):
        some = found[at : at + MOST]
        bits = np.zeros(BITS, np.uint8)
        for i in range(HASHES):
            bits[(some >> np.uint64(9 + 11 * i)) & np.uint64(BITS - 1)] = 1
        chain.append((len(some), np.packbits(bits)))
    return chain


def likeness(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]]) -> float:
    """Normalised bit overlap of two chains, from 0 to 1: each filter of the shorter one against its best match."""
    if not a or not b:
        return float(not a and not b)
    if (len(a), sum(n for n, _ in a)) > (len(b), sum(n for n, _ in b)):
        a, b = b, a
    other = np.stack([f for _, f in b])
    ones = np.bitwise_count(other).sum(1, dtype=np.int64)
    total = weight = 0.0
    for n, one in a:
        own = int(np.bitwise_count(one).sum(dtype=np.int64))
        both = np.bitwise_count(other & one).sum(1, dtype=np.int64)
        chance, most = own * ones / BITS, np.minimum(own, ones)
        total += n * float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
        weight += n
    return total / weight


def spelled(chain: list[tuple[int, np.ndarray]]) -> str:
    return ".".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in chain)


def rarity(docs: DataFrame) -> list[int]:
    """Rank of each entropy level, 0 the rarest, from all windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                for text in texts:
                    counts += np.bincount(window_levels(filled(np.frombuffer(text, np.uint8))), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS), pa.int32()), pa.array(counts)], names=["level", "n"])

    found = {r["level"]: r["n"] for r in id_and_text(docs).select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    order = sorted(range(LEVELS), key=lambda x: (found.get(x, 0), x))
    return [order.index(x) for x in range(LEVELS)]


def edited(text: str, following: str) -> tuple[str, int, int]:
    """The text with its last third replaced by as much of the beginning of the following one; code points kept and taken."""
    n = len(text) // 3
    taken = following[:n]
    return text[: len(text) - n] + taken, len(text) - n, len(taken)


class Digests:
    """Digests of a text and its edited text; the edited one's window levels are those of its two parts but at the seam."""

    def __init__(self, rank: list[int]):
        self.rank = np.array(rank)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, list]:
        data = filled(np.frombuffer(text.encode(), np.uint8))
        levels = window_levels(data)
        return data, levels, digest(data, self.rank, levels)

    def of_edited(self, text: str, kept: int, mine: np.ndarray, other: np.ndarray) -> list:
        data = np.frombuffer(text.encode(), np.uint8)
        cut = len(text[:kept].encode())
        if cut < WINDOW or len(data) - cut < WINDOW:  # too short for windows of its own on either side
            return digest(data, self.rank)
        mid_from, mid_to = cut - WINDOW + 1, cut
        seam = window_levels(data[mid_from : mid_to + WINDOW - 1])
        return digest(data, self.rank, np.concatenate([mine[:mid_from], seam, other[: len(data) - cut - WINDOW + 1]]))


@dataclass
class Ranges:
    """Ranges of (order, hash): cuts of ``order``; the hash splits what is equal, where cuts are equal too."""

    cuts: np.ndarray
    heads: dict[int, tuple[int, int]] | None = None  # the first (order, hash) of each range that has rows

    def of(self, order: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.cuts, order, "left"), np.searchsorted(self.cuts, order, "right")
        share = (hashed ^ np.int64(-1 << 63)).view(np.uint64) / 2.0**64  # grows with the hash
        return np.minimum(hi, lo + (share * (hi - lo + 1)).astype(np.int64))

    def also(self, order: np.ndarray, hashed: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """The range before, for the first rows of each range; -1 for others."""
        used = np.array(sorted(self.heads))
        first = np.array([self.heads[r] for r in used.tolist()])
        at = np.searchsorted(used, ranges)
        is_first = (first[at, 0] == order) & (first[at, 1] == hashed)
        return np.where(is_first, used[at - 1], -1)  # before the first comes the last


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row for each row of ``docs``.

    The following document is the next one in descending doc_id (nulls last, ties by a hash of the text), after the
    last the first; a single document follows itself. Null texts are empty; an empty text has an empty
    fingerprint, which is like an empty one alone, and any other has one feature at least. Very long texts are taken
    whole, one at a time. An empty table gives an empty result; other columns are ignored.

    The rows are dealt by ranges of doc_id, and of hashes where many rows have one id. The first row of each range is
    also dealt to the range before it, so each range has all neighbours it needs and no task sees more than its range."""
    spark = docs.sparkSession
    narrow = id_and_text(docs).withColumn("order", F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1))).withColumn("hash", F.xxhash64("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = narrow.stat.approxQuantile("order", [i / parts for i in range(1, parts)], 0.2 / parts)
    ranges = Ranges(np.array(sorted(min(int(x), (1 << 63) - 1) for x in cuts), np.int64))

    @F.arrow_udf("int")
    def range_of(order: pa.Array, hashed: pa.Array) -> pa.Array:
        return pa.array(ranges.of(order.to_numpy(zero_copy_only=False), hashed.to_numpy(zero_copy_only=False)), pa.int32())

    @F.arrow_udf("array<struct<range:int,tail:int>>")
    def dealt_to(order: pa.Array, hashed: pa.Array) -> pa.Array:
        a, b = order.to_numpy(zero_copy_only=False), hashed.to_numpy(zero_copy_only=False)
        own = ranges.of(a, b)
        also = ranges.also(a, b, own)
        rows = [[{"range": x, "tail": 0}] if y < 0 else [{"range": x, "tail": 0}, {"range": y, "tail": 1}] for x, y in zip(own.tolist(), also.tolist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("range", pa.int32()), ("tail", pa.int32())])))

    placed = narrow.select("order", "hash", range_of("order", "hash").alias("range"))
    heads = placed.groupBy("range").agg(F.min(F.struct("order", "hash")).alias("head")).collect()  # one for each range
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    ranges.heads = {r["range"]: (r["head"]["order"], r["head"]["hash"]) for r in heads}
    rows = narrow.withColumn("to", F.explode(dealt_to("order", "hash"))).select("doc_id", "text", "order", "hash", "to.range", "to.tail")
    placed = rows.repartitionByRange(parts, "range").sortWithinPartitions("range", "tail", "order", "hash", "text")
    rank = rarity(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(rank)
        last = None  # (doc_id, text, data, levels, chain) that waits for its follower
        out: list[tuple] = []
        for batch in slices(batches):
            for doc_id, text, tail in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if last is None and tail:
                    continue  # further ties of the range's tail
                data, levels, chain = digests.of(text)
                if last is not None:
                    new, kept, _ = edited(last[1], text)
                    own = digests.of_edited(new, kept, last[3], levels)
                    out.append((last[0], len(last[1]), hashlib.sha256(new.encode()).hexdigest(), spelled(last[4]), spelled(own), likeness(last[4], own), likeness(last[4], chain)))
                last = None if tail else (doc_id, text, data, levels, chain)
                if len(out) >= 500:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return placed.select("doc_id", "text", "tail").mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
