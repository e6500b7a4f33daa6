"""The operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprint, licenses, linededup, merkle, minhash, mixing, packing, pii, quality, runs, selection, toxicity
from .common import table


def on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def with_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, as_given=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": on_documents(lambda docs: minhash.near_duplicates(docs, width=4)),
    "op2_toxicity": with_labels(toxicity.scored),
    "op3_quality": with_labels(quality.scored),
    "op4_fingerprints": on_documents(fingerprint.fingerprints),
    "op5_licenses": on_documents(licenses.scanned),
    "op6_ann": nearest,
    "op7_pii": on_documents(pii.redactions),
    "op8_line_dedup": on_documents(linededup.query),
    "op9_best_fit_packing": on_documents(packing.best_fit),
    "op10_mixing": with_labels(lambda docs, labels: mixing.mixed(docs, mixing.label_domains(labels))),
    "op11_exact_top_k": top,
    "op12_merkle_manifest": on_documents(merkle.query),
    "op13_periodic_runs": on_documents(runs.query),
}

ORACLE_SQL: dict[str, str] = {"op8_line_dedup": linededup.ORACLE, "op11_exact_top_k": selection.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
