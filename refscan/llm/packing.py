"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Texts become token ids, end with id 0, and are cut into pieces only beyond the capacity. A piece's length
is all that packing depends on, so the plan is made for the histogram of lengths (as many numbers as the
capacity, however large the corpus): whole groups of equal sequences are fixed or filled at once. The plan
is a table of intervals, and each piece finds its place by its length and its rank among equal lengths.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, id_and_text, slices, written


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Token ids of each space-free part, as little-endian unsigned 32-bit bytes. The tokenizer drops white
    space before it merges anything, so ids of a text are those of its parts in order. Unknown parts are
    encoded together: words of letters with spaces between them, each of which ends with its only
    word-ending token, others with the end-of-text token between them."""

    SEPARATOR, SEPARATOR_ID, WORD_END = "<|endoftext|>", 49407, "</w>"
    MOST = 400_000  # parts kept

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(self.WORD_END)]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.encode_batch([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        return self.ids(part)

    def learn(self, parts: set[str], latin: bool) -> None:
        """Keeps the ids of unknown parts."""
        if len(self) > self.MOST:
            self.clear()
        words, others = [], []
        for p in parts:
            if len(p) < 64 and "<|" not in p:
                (words if latin and p.isalpha() else others).append(p)
        for at in range(0, len(words), 1_000):
            some = words[at : at + 1_000]
            whole = self.ids(" ".join(some))
            ends = (4 * (np.flatnonzero(self.ends_word[np.frombuffer(whole, "<u4")]) + 1)).tolist()
            first = 0
            for part, end in zip(some, ends, strict=True):
                self[part] = whole[first:end]
                first = end
        for at in range(0, len(others), 5_000):
            some = others[at : at + 5_000]
            ids = np.frombuffer(self.ids(self.SEPARATOR.join(some)), "<u4")
            ends = [*np.flatnonzero(ids == self.SEPARATOR_ID).tolist(), len(ids)]
            whole, first = ids.tobytes(), 0
            for part, end in zip(some, ends, strict=True):
                self[part] = whole[4 * first : 4 * end]
                first = end + 1


#: A single mark between a Latin-1 letter and white space; it is a token of its own.
TRAILING = re.compile("[.,;:!?](?<=[a-z\xdf-\xf6\xf8-\xff].)(?=[ \n]|$)")


def parted(text: str) -> tuple[list[str], bool]:
    """Parts of a text, and whether it is Latin-1. If so (its letters have one composed form and one lower case
    each, as the tokenizer takes them), words that differ in case or in what follows them are one part. A text with
    ``<|`` keeps its case: the tokenizer knows its special tokens in lower case alone."""
    try:
        if "<|" in text:
            raise ValueError
        text.encode("latin-1")
    except ValueError:  # an encoding error is one
        return text.replace("\n", " ").split(" "), False
    return TRAILING.sub(r" \g<0>", text.lower()).replace("\n", " ").split(" "), True


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row for each piece of each text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, some = WordIds(path), [], []  # parts are remembered for one task
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 200):
                some = [(*parted(t), doc_id) for t, doc_id in zip(texts[at : at + 200], doc_ids[at : at + 200], strict=True)]
                known = [list(map(ids.get, parts)) for parts, _, _ in some]
                for latin in (True, False):
                    ids.learn({p for (parts, own, _), got in zip(some, known, strict=True) if own == latin for p, x in zip(parts, got, strict=True) if x is None}, latin)
                for (parts, _, doc_id), got in zip(some, known, strict=True):
                    whole = b"".join([ids[p] if x is None else x for p, x in zip(parts, got, strict=True)]) + b"\0\0\0\0"
                    for i, start in enumerate(range(0, len(whole), 4 * capacity)):
                        cut = whole[start : start + 4 * capacity]
                        for column, value in zip(rows, (doc_id, i, start // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del ids, known, some
        freed()

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Interval = tuple[int, int, int, int, int]  # length, first rank, end rank, sequence of the first rank, offset


def packed(counts: dict[int, int], capacity: int) -> list[Interval]:
    """The plan for ``counts`` pieces of each length: intervals of ranks that go to consecutive sequences."""
    left = Counter({s: n for s, n in counts.items() if n > 0})
    used: Counter[int] = Counter()
    plan: list[Interval] = []
    sequences = 0

    def place(size: int, n: int, sequence: int, offset: int) -> None:
        plan.append((size, used[size], used[size] + n, sequence, offset))
        used[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]

    def fix(n: int, *sizes: int) -> None:
        nonlocal sequences
        offset = 0
        for size in sizes:
            place(size, n, sequences, offset)
            offset += size
        sequences += n

    def partner(size: int) -> int | None:
        """With what ``size`` can be fixed: 0 for nothing, None if no choice is proven to dominate the others."""
        room = capacity - size
        sizes = sorted(left)
        fitting = sizes[: bisect.bisect_right(sizes, room)]
        if fitting and fitting[-1] == size and left[size] == 1:
            fitting.pop()
        if not fitting:
            return 0
        best, least = fitting[-1], fitting[0]
        if best == room or room < 2 * least:  # an exact fill, or only one other fits: the largest that does dominates
            return best
        if room < 3 * least:  # two others fit at most: one dominates if it is as large as the best two together
            lo, hi, two = 0, len(fitting) - 1, 0
            while lo <= hi:
                total = fitting[lo] + fitting[hi]
                if total <= room:
                    if lo < hi or left[fitting[lo]] > 1:
                        two = max(two, total)
                    lo += 1
                else:
                    hi -= 1
            if best >= two:
                return best
        return None

    reduced = True
    while reduced:
        reduced = False
        for size in sorted(left, reverse=True):
            while left[size] and (other := partner(size)) is not None:
                reduced = True
                if not other:
                    fix(left[size], size)
                elif other == size:
                    fix(left[size] // 2, size, size)
                else:
                    fix(min(left[size], left[other]), size, other)
            if not left[size]:
                del left[size]

    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def give(room: int, first: int, n: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((first, n))

    for size in sorted(left, reverse=True):
        while left[size]:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                n = max(1, left[size] // (capacity // size))
                give(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[at]
            first, n = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            take = min(n, left[size])
            if take < n:
                give(room, first + take, n - take)
            place(size, take, first, capacity - room)
            if room > size:
                give(room - size, first, take)
    return plan


def best_fit(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of ``docs``.

    A null or empty text is id 0 alone; repeated rows and null ids are packed like any other row; an empty
    table gives an empty result; other columns are ignored. A very long text is tokenized word by word and cut, whole."""
    spark = docs.sparkSession
    found = written(pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = spark.createDataFrame(packed(counts, capacity), "length long, rank_from long, rank_to long, sequence_from long, offset long")
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))).join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base") - 1)
    # The plan is broadcast: its size depends on the capacity alone, never on the documents.
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).drop(plan["length"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
