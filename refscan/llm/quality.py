"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Each passage is encoded from what it looks like (shares
of kinds of characters, word shapes, repetition within the passage and of whole passages); a hidden layer
turns that into a representation h. Gated attention, softmax over passages of w . (tanh(V h) * sigmoid(U h)),
weights the passages, and a logistic unit scores the weighted sum. Everything is learned from
document labels alone, by Adam with hand-written gradients, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, sampled, slices, texts_of

#: Words of a passage.
WORDS = 64
#: Labelled documents and their bytes to learn from, at the most (in expectation): longer texts, fewer documents.
TRAIN_ROWS, TRAIN_BYTES = 6_000, 60_000_000
HIDDEN, GATES = 16, 8
THRESHOLD = 0.3

#: Kinds of bytes: each is a feature, as its share of the passage.
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b".", b",;:", b"!?", b"%&$#*@^~", b"|", b"<>{}[]()=+/\\_", b"\"'`-", bytes(range(128, 256)))
KIND = np.full(256, len(KINDS), np.int64)
for _i, _kind in enumerate(KINDS):
    KIND[list(_kind)] = _i
FEATURES = len(KINDS) + 1 + 6


def passages(text: bytes) -> list[list[bytes]]:
    words = text.split()
    return [words[i : i + WORDS] for i in range(0, len(words), WORDS)] or [[]]


def encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``texts``, and the number of passages of each text."""
    counts, joined, extra = [], [], []
    for text in texts:
        bag = passages(text)
        seen: set[bytes] = set()
        words_seen: set[bytes] = set()
        counts.append(len(bag))
        for words in bag:
            whole = b" ".join(words)
            own = set(words)
            n = len(words) or 1
            new = len(own - words_seen)
            extra.append((len(whole) / n / 10, len(own) / n, new / n, float(whole in seen), max(map(len, words), default=0) / 30, len(words) / WORDS))
            seen.add(whole)
            words_seen |= own
            joined.append(whole)
    lengths = np.array([len(x) for x in joined])
    owner = np.repeat(np.arange(len(joined)), lengths)
    kinds = KIND[np.frombuffer(b"".join(joined), np.uint8)]
    width = len(KINDS) + 1
    shares = np.bincount(owner * width + kinds, minlength=len(joined) * width).reshape(len(joined), width) / np.maximum(lengths, 1)[:, None]
    return np.hstack([np.sqrt(shares), np.array(extra)]).astype(np.float32), np.array(counts)


@dataclass
class Model:
    """Weights: E, e encode passages; V, U, w are the attention; c, b score the weighted sum."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        k = self.weights
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ k["E"] + k["e"])
        tv, su = np.tanh(h @ k["V"]), 1 / (1 + np.exp(-(h @ k["U"])))
        a = (tv * su) @ k["w"]
        top = np.maximum.reduceat(a, starts)
        a = np.exp(a - np.repeat(top, counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(h * a[:, None], starts)
        return {"x": x, "h": h, "tv": tv, "su": su, "a": a, "z": z, "starts": starts, "p": 1 / (1 + np.exp(-(z @ k["c"] + k["b"])))}

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, counts = encoded(texts)
        return self.forward(x, counts)["p"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, dict[str, np.ndarray]]:
        k, f = self.weights, self.forward(x, counts)
        p, h, a, tv, su = f["p"], f["h"], f["a"], f["tv"], f["su"]
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        d = (p - y) / len(y)
        dz = np.repeat(d[:, None] * k["c"], counts, axis=0)
        da = (dz * h).sum(1)
        dl = a * (da - np.repeat(np.add.reduceat(a * da, f["starts"]), counts))
        dtv, dsu = dl[:, None] * su * k["w"], dl[:, None] * tv * k["w"]
        dv, du = dtv * (1 - tv**2), dsu * su * (1 - su)
        dh = dz * a[:, None] + dv @ k["V"].T + du @ k["U"].T
        de = dh * (1 - h**2)
        g = {"E": f["x"].T @ de, "e": de.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (tv * su).T @ dl, "c": f["z"].T @ d, "b": d.sum()}
        return loss, {n: v + decay * k[n] if n != "b" else v for n, v in g.items()}


def fitted(bags: list[tuple[np.ndarray, float]], epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the bags (features of its passages, label); the seed is fixed, so equal rows give equal models."""
    rng = np.random.default_rng(7)
    every = np.concatenate([x for x, _ in bags])
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    share = np.clip(np.mean([y for _, y in bags]), 0.01, 0.99)
    weights = {"E": init(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATES), "U": init(HIDDEN, GATES), "w": init(GATES), "c": init(HIDDEN), "b": np.array(np.log(share / (1 - share)))}
    model = Model(weights, every.mean(0), every.std(0) + 1e-3)
    first = {n: np.zeros_like(v) for n, v in weights.items()}
    second = {n: np.zeros_like(v) for n, v in weights.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = [bags[i] for i in order[at : at + batch]]
            _, g = model.gradients(np.concatenate([x for x, _ in some]), np.array([len(x) for x, _ in some]), np.array([y for _, y in some]), decay)
            t += 1
            for n in weights:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
                weights[n] = weights[n] - rate * (1 - epoch / epochs) * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
    return model


def training_bags(docs: DataFrame, labels: DataFrame, train_rows: int, train_bytes: int) -> list[tuple[np.ndarray, float]]:
    """Bags of a sample of labelled documents that aren't held out; about a fifth of train_bytes come to the driver."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("label")).where(crc_mod("doc_id", 5) != 0)
    n = known.count()
    wide = known.where(sampled(16 * train_rows / max(1, n), "doc_id"))
    # Of 16 x train_rows narrow rows, broadcast, the mean size of a labelled text.
    size = id_and_text(docs).join(F.broadcast(wide), "doc_id").agg(F.avg(F.octet_length("text"))).first()[0]
    rows_wanted = min(train_rows, train_bytes / max(1.0, size or 1.0))
    picked = F.broadcast(known.where(sampled(rows_wanted / max(1, n), "doc_id")))  # train_rows narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                x, counts = encoded(batch.column(1).cast(pa.binary()).to_pylist())
                bags = np.split(x, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b.tobytes() for b in bags], pa.binary())], names=["doc_id", "label", "bag"])

    rows = id_and_text(docs).join(picked, "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label double, bag binary").collect()
    return [(np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES), r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["bag"])))]


def scorer(docs: DataFrame, labels: DataFrame, train_rows: int, train_bytes: int) -> Callable[[Column], Column]:
    """Learns a model; gives the function from a text column to its scores (texts go to Python in Arrow batches, other columns don't)."""
    bags = training_bags(docs, labels, train_rows, train_bytes)
    model = fitted(bags) if bags else None

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        scores = [model.score(texts) if model else np.ones(len(texts)) for texts in texts_of(batch)]
        return pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())

    return lambda text: score(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``; score is that of label 1.

    Null and empty texts are one empty passage and get that passage's score; very long ones have as many passages as they
    need, all scored. Of labels with a repeated id the
    larger counts, null labels and ids don't; null doc_ids are scored (and count as the empty text for
    held_out); without labels every score is 1. An empty table gives an empty result. Other columns,
    whatever their names, are never inputs."""
    score = scorer(docs, labels, train_rows, train_bytes)
    found = id_and_text(docs).select("doc_id", score(F.col("text")).alias("score"))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The rows and columns of ``docs`` that are predicted good; nulls, long texts and missing labels as in ``scored``."""
    return docs.where(scorer(docs, labels, train_rows, train_bytes)(F.col("text")) >= THRESHOLD)
