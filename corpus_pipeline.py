"""Training-text pipeline: each stage takes (spark, docs, sf_dir) and gives the next one's documents.

1. quality: documents that the quality classifier rejects go.
2. line_dedup: all multi-line chunks that occur elsewhere are removed but for the first occurrence, whatever
   their share of a text; documents of which nothing is left go. Of a near-copy its own lines stay.
3. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays.
4. mixing: documents are left out or repeated by the rates that bring toxic and low-quality tokens
   down to their target weights, where they have more; clean tokens keep their total.
5. packing: token sequences of at most 2048, as few as possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refscan.llm import linededup, minhash, mixing, packing, quality
from refscan.llm.common import dropped, fresh, table, temporary, written

#: Shares of tokens after mixing: of toxic and low-quality ones, at the most.
WEIGHTS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}

# All stages take tables with any further columns, whatever their names, and give them on (but the last); an empty table
# gives an empty one; very long texts are processed whole.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts, rows with null or repeated ids are scored like others; without labels all rows stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null and empty ones empty; a null id comes first; n_chars, if there is one, follows a changed text."""
    (report,) = fresh(docs, "report")
    found = linededup.line_dedup(docs, report=report).where(~F.col(f"{report}.emptied"))
    if "n_chars" in docs.columns:
        text_size = F.when(F.col(f"{report}.removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", text_size.cast(docs.schema["n_chars"].dataType))
    return found.drop(report)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words and with null ids stay; repeated rows of one id are one document and stay together or go together."""
    return minhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with null ids stay once; rows of one id have one rate; without labels or tokens all rows stay once."""
    return mixing.resampled(docs, mixing.label_domains(table(spark, sf_dir, "labels")), WEIGHTS, anchor="clean")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are their end mark alone; every row is packed, whatever its id."""
    return packing.best_fit(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenization and the classifiers have no SQL: tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents; a stage's tables are deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = written(stage(spark, docs, sf_dir), name, outside=True)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
