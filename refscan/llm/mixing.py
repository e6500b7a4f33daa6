"""Mixing to target weights with soft domain membership.

A multinomial classifier, fitted on a bounded sample of a labelled table, predicts for each document the
posterior of each domain. With t tokens and posteriors p, a document that is used ``rate`` times adds
rate * t * p_k expected tokens to domain k. Nonnegative rates are fitted by projected gradient on the
squared distance of the domains' expected totals from their targets, from rate 1 on. The residual is
weighted by the inverse of the domains' overlap matrix, under which a step of length 1 is a plain
gradient step and meets the targets at once wherever no rate is clipped at 0. A step takes one sum for
each domain over all documents; rates never leave the executors.

Only DataFrame functions and the JVM's own ML stages are used.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, sampled, written

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.8, "low": 0.1, "toxic": 0.1}
#: Labelled documents that the classifier is fitted on, at the most (in expectation).
TRAIN_ROWS = 8_000
HASHED = 4096


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic, low (quality 0) or clean; rows without both labels and ids are no labels, of repeated ids the largest label counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(domain).cast("double").alias("domain"))


def word_lists(docs: DataFrame) -> DataFrame:
    """doc_id, text, words (space-separated, lower case)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return narrow.withColumn("words", F.filter(F.split(F.translate(F.lower("text"), "\n", " "), " "), lambda w: w != ""))


def featured(words: DataFrame) -> DataFrame:
    """Adds ``features``: hashed word counts of unit length, and densities of junk marks."""
    density = lambda mark: (F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))) / F.greatest(F.length("text"), F.lit(1))
    marked = words.withColumns({f"mark_{i}": density(m) for i, m in enumerate(("!!", "%%", "&&", "$$", "**", "|"))}).withColumn("distinct", F.size(F.array_distinct("words")) / F.greatest(F.size("words"), F.lit(1)))
    hashed = Normalizer(inputCol="counts", outputCol="unit").transform(HashingTF(numFeatures=HASHED, inputCol="words", outputCol="counts").transform(marked))
    return VectorAssembler(inputCols=["unit", *(f"mark_{i}" for i in range(6)), "distinct"], outputCol="features").transform(hashed)


def posteriors(docs: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, tokens, p (array by DOMAINS): soft membership of every row of ``docs``.

    ``labelled``: doc_id, domain (index). Without labels every domain is equally likely."""
    spark = docs.sparkSession
    words = word_lists(docs)
    n = labelled.count()
    share = min(1.0, train_rows / max(1, n))
    # Broadcast: train_rows narrow rows in expectation, whatever the size of the table.
    picked = F.broadcast(labelled.where(sampled(share, "doc_id")))
    train = written(featured(words.join(picked, "doc_id")).select("features", "domain"), "mixing-train")
    seen = sorted(int(r["domain"]) for r in train.select("domain").distinct().collect())
    tokens = F.size("words").cast("long").alias("tokens")
    if len(seen) < 2:
        flat = [1.0 if seen else 1 / len(DOMAINS)] if not seen else None
        p = F.array(*(F.lit(flat[0] if flat else float(k == seen[0])) for k in range(len(DOMAINS))))
        return written(words.select("doc_id", tokens, p.alias("p")), "mixing-posteriors")
    model = LogisticRegression(labelCol="domain", family="multinomial", regParam=1e-3, maxIter=40, probabilityCol="probability").fit(train.repartition(max(2, spark.sparkContext.defaultParallelism)))
    scored = model.transform(featured(words)).withColumn("found", vector_to_array("probability"))
    p = F.array(*(F.col("found")[k] if k < model.numClasses else F.lit(0.0) for k in range(len(DOMAINS))))
    return written(scored.select("doc_id", tokens, p.alias("p")), "mixing-posteriors")


def stepped(rate: Column, gradient: np.ndarray) -> Column:
    """A projected step: rates stay nonnegative."""
    return F.greatest(F.lit(0.0), rate - sum((F.col("p")[k] * float(g) for k, g in enumerate(gradient)), F.lit(0.0)))


def fitted_rates(found: DataFrame, targets: dict[str, float], anchor: str | None = None, steps: int = 25, close: float = 1e-4) -> DataFrame:
    """Adds ``rate`` to doc_id, tokens, p. Targets are shares of all tokens. With an anchor they are shares of the
    total at which the anchor domain keeps its tokens, and limits: a domain that has less isn't raised to it.

    The descent ends when all totals are within ``close`` of all tokens from their targets; if they aren't after
    ``steps`` steps (targets out of reach, as rates can't be negative) a warning states how far they are."""
    of = range(len(DOMAINS))
    weight = F.col("tokens").cast("double")
    first = found.agg(F.sum(weight).alias("all"), *(F.sum(weight * F.col("p")[k]).alias(f"a{k}") for k in of), *(F.sum(weight * F.col("p")[k] * F.col("p")[j]).alias(f"m{k}_{j}") for k in of for j in of)).first()
    total = first["all"] or 0.0
    if not total:
        return found.withColumn("rate", F.lit(1.0))
    overlap = np.array([[first[f"m{k}_{j}"] for j in of] for k in of]) / total
    shares = np.array([targets[d] for d in DOMAINS])
    at = np.array([first[f"a{k}"] for k in of])
    goal = shares / shares.sum() * (total if anchor is None else at[DOMAINS.index(anchor)] * shares.sum() / targets[anchor])
    goal = np.where(at > 0, goal, 0.0)  # a domain without any document can't be filled
    rate, base = F.lit(1.0), found
    for step in range(1, steps + 1):
        # Within its limit a domain has no pull, or its few short documents would be repeated over and over.
        bound = [k for k in of if anchor in (None, DOMAINS[k]) or at[k] > goal[k]]
        if np.abs((at - goal)[bound]).max() <= close * total:
            break
        gradient = np.zeros(len(DOMAINS))
        gradient[bound] = np.linalg.pinv(overlap[np.ix_(bound, bound)], rcond=1e-9) @ (at - goal)[bound] / total
        rate = stepped(rate, gradient)
        if step % 6 == 0:  # keeps the expression short
            base = written(base.select("doc_id", "tokens", "p", rate.alias("rate")), "mixing-rates")
            rate = F.col("rate")
        sums = base.agg(*(F.sum(rate * weight * F.col("p")[k]).alias(f"a{k}") for k in of)).first()
        at = np.array([sums[f"a{k}"] for k in of])
    else:
        bound = [k for k in of if anchor in (None, DOMAINS[k]) or at[k] > goal[k]]
        far = {DOMAINS[k]: round(float((at - goal)[k] / total), 6) for k in bound}
        if max(map(abs, far.values())) > close:
            warnings.warn(f"targets are not met after {steps} steps; distance as shares of all tokens: {far}", stacklevel=2)
    return base.withColumn("rate", rate)


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies for a rate: rounded up with the fraction's probability, by a hash of the id."""
    return F.floor(rate + F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) / (1 << 20)).cast("long")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, anchor: str | None = None) -> DataFrame:
    """doc_id, tokens, p_clean, p_low, p_toxic, rate, copies: one row for each row of ``docs``.

    Null and empty texts have no tokens: they get a posterior and a rate, and weigh nothing; very long ones count whole. Rows with a
    null or repeated id are rated like others (rows of one id round alike). Without labels posteriors are
    equal; a table without tokens has rates of 1; an empty table gives an empty result."""
    found = fitted_rates(posteriors(docs, labelled), targets or TARGETS, anchor)
    return found.select("doc_id", "tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def resampled(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str | None = None) -> DataFrame:
    """The rows and columns of ``docs``, each as often as its rate says; rows of one id share the mean rate, null ids stay once."""
    rated_id, rate, n_copies, copy = fresh(docs, "rated_id", "rate", "copies", "copy")
    rates = mixed(docs, labelled, targets, anchor).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(rated_id)).agg(F.avg("rate").alias(rate))
    changed = rates.withColumn(n_copies, copies(F.col(rate), F.col(rated_id))).where(F.col(n_copies) != 1).select(rated_id, n_copies)
    joined = docs.join(changed, docs["doc_id"].cast("long") == changed[rated_id], "left")
    n = F.coalesce(F.col(n_copies), F.lit(1)).cast("int")
    return joined.where(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).drop(rated_id, n_copies, copy)
