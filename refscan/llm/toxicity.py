"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (a short fixed list and words learned from labelled texts), their proximity
to the second person, capitals, punctuation, and obfuscated spellings. Labelled rows are split by a hash of
their id into three parts: the lexicon is learned on the first, the trees on the second, and the
isotonic map from tree score to probability on the third. Held-out rows take no part in any.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, sampled, temporary, texts_of, written

#: Labelled documents to learn from, at the most (in expectation).
TRAIN_ROWS = 15_000
#: Learned words, at the most.
LEXICON_WORDS = 400
THRESHOLD = 0.3

# Common insults, and the second person in the corpus's languages.
INSULTS = "idiot idiots moron morons stupid loser losers clown scum worthless pathetic dumb trash garbage fool imbecile disgusting coward hate idiota imbécil estúpido basura payaso débile crétin imbécile clown ordure abruti nul dummkopf trottel abschaum wertlos erbärmlich"
SECOND_PERSON = "you your yours yourself you're u ur tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch usted ustedes tú ti vosotros vuestro"

NEAR = 5  # words
PLAIN = bytes(c if chr(c).isalnum() or c >= 128 or c == 39 else 32 for c in range(256)).lower()
UNMASK = bytes.maketrans(b"0134578@$!", b"oieastbasi")
MASKED = re.compile(rb"[A-Za-z]+[0-9@$!*]+[A-Za-z]+")


class Features:
    def __init__(self, learned: dict[str, float]):
        self.fixed = {w.encode() for w in INSULTS.split()}
        self.second = {w.encode() for w in SECOND_PERSON.split()}
        self.learned = {w.encode(): v for w, v in learned.items()}
        self.known = self.fixed | set(self.learned)

    def of(self, text: bytes) -> list[float]:
        words = text.translate(PLAIN).split()
        n = max(1, len(words))
        there = self.known.intersection(words)
        fixed = hits = near = strong = run = 0
        weight = top = 0.0
        if there:
            you = [i for i, w in enumerate(words) if w in self.second]
            last = -(10**9)
            for i, w in enumerate(words):
                if w not in there:
                    continue
                hits += 1
                fixed += w in self.fixed
                v = self.learned.get(w, 0.0)
                weight += v
                top = max(top, v)
                strong += v > 2
                run += i - last <= 30
                last = i
                if you:
                    at = bisect.bisect_left(you, i)
                    near += min(abs(you[k] - i) for k in (at - 1, at) if 0 <= k < len(you)) <= NEAR
        masked = MASKED.findall(text)
        unmasked = sum(m.lower().replace(b"*", b"").translate(UNMASK) in self.known or m.lower().translate(UNMASK) in self.known for m in masked)
        size = max(1, len(text))
        upper = sum(map(text.count, UPPER))
        return [fixed / n, hits / n, weight / n, top, strong / n, float(len(there)), float(min(hits, 50)), near / n, run / n, upper / size, (text.count(b"!") + text.count(b"?")) / size, (text.count(b"%") + text.count(b"&") + text.count(b"$") + text.count(b"#") + text.count(b"*")) / size, len(masked) / n, unmasked / n, float(np.log1p(n)), text.count(b"|") / size]

    def column(self) -> Callable[[Column], Column]:
        @F.arrow_udf("array<double>")
        def features(batch: pa.Array) -> pa.Array:
            return pa.array([self.of(t) for some in texts_of(batch) for t in some], pa.list_(pa.float64()))

        return features


UPPER = tuple(bytes([c]) for c in range(65, 91))


def lexicon(rows: DataFrame, words: int) -> dict[str, float]:
    """Words that mark toxic texts and their log odds, from text and label."""
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    each = rows.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}']+"))).alias("word")).where("word <> ''")
    counts = each.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")).where("bad >= 3")
    odds = counts.select("word", "bad", F.log((F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))).alias("odds")).where("odds > 1")
    best = odds.orderBy((F.col("odds") * F.sqrt("bad")).desc(), "word").limit(words)
    return {r["word"]: r["odds"] for r in best.collect()}


def learned(docs: DataFrame, labels: DataFrame, train_rows: int):
    """The features' function, the function that adds ``score`` to rows with ``features``, and the share of label 1; functions are None without two classes."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).where(crc_mod("doc_id", 4) != 2)
    n, bad = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = bad / max(1, n)
    picked = F.broadcast(known.where(sampled(train_rows / max(1, n), "doc_id")))  # train_rows narrow rows
    with temporary(docs.sparkSession):
        rows = written(id_and_text(docs).join(picked, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(6))), "toxicity-train")
        features = Features(lexicon(rows.where("part < 2"), LEXICON_WORDS)).column()
        dense = written(rows.where("part >= 2").select("part", F.col("label").cast("double").alias("label"), array_to_vector(features(F.col("text"))).alias("features")), "toxicity-features").repartition(6)
        trees_on, rest = dense.where("part < 5").cache(), dense.where("part = 5")
        try:
            if trees_on.select("label").distinct().count() < 2:
                return None, None, prior
            trees = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=7, minInstancesPerNode=5).fit(trees_on)
        finally:
            trees_on.unpersist()
        raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
        held = raw(rest).select("label", "raw")
        if held.select("label").distinct().count() < 2:
            return features, lambda df: raw(df).withColumn("score", F.col("raw")), prior
        iso = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
    # ties of the step function are told apart by a hundredth of the trees' own probability
    return features, lambda df: iso.transform(raw(df).drop("prediction")).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("raw")))), prior


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``; score is that of label 1.

    Null and empty texts have no words and get the score of that; very long ones are scored whole. Of labels with a
    repeated id the larger counts, null labels and ids don't; null doc_ids are scored (and count as the empty text for
    held_out); if the labelled documents lack one of the classes every score is the share of label 1 among the labels
    (0 without any). An empty table gives an empty result. Other columns, whatever their names, are never inputs."""
    features, score, prior = learned(docs, labels, train_rows)
    narrow = id_and_text(docs)
    if score is None:
        found = narrow.withColumn("score", F.lit(float(prior)))
    else:
        found = score(narrow.select("doc_id", array_to_vector(features(F.col("text"))).alias("features")))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
