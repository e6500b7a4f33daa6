"""Verdicts: status, count and kept references of each attachment; counts; storing and reading them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.site import BINARY, Collation

#: References kept for each attachment.
KEPT = 20
#: Parts that an attachment's references are dealt to.
PARTS = 16
SCHEMA = "array<struct<d:string,t:string,i:long,k:string,m:string,c:string>>"
STATUSES = ("used", "unused")


def verdicts(contexts: DataFrame, refs: DataFrame, scanned_at: int, is_used: Callable[[Column, DataFrame], Column] | None = None) -> DataFrame:
    """attachment_id, status, ref_count, refs_json, scanned_at: one row for each context.

    All references count; only those that aren't mere information make an attachment used. Of many the
    first KEPT stay, by detector, object, detail and match. ``is_used`` may replace the computed boolean."""
    # In one pass: references are dealt to parts, each part counts and keeps its first KEPT, and an attachment's parts are
    # then put together. So a hot attachment has many tasks, and no more than KEPT x PARTS references in one row.
    part = ["attachment_id", "part"]
    ranked = refs.withColumn("part", F.pmod(F.xxhash64("object_id", "detail"), F.lit(PARTS))).withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("ord", "object_id", "detail", "match")))
    short = F.struct("ord", "object_id", "detail", "match", F.struct(F.col("detector").alias("d"), F.col("object_type").alias("t"), F.col("object_id").alias("i"), F.col("detail").alias("k"), F.col("match").alias("m"), F.col("confidence").alias("c")).alias("r"))
    parts = ranked.groupBy(*part).agg(F.count("*").alias("ref_count"), F.bool_or(F.col("confidence") != "info").alias("counts"), F.collect_list(F.when(F.col("n") <= KEPT, short)).alias("kept"))
    found = parts.groupBy("attachment_id").agg(F.sum("ref_count").alias("ref_count"), F.bool_or("counts").alias("counts"), F.slice(F.array_sort(F.flatten(F.collect_list("kept"))), 1, KEPT).alias("kept"))
    joined = contexts.join(found, "attachment_id", "left")
    used = F.coalesce("counts", F.lit(False))
    used = is_used(used, joined) if is_used else used
    json = F.coalesce(F.to_json(F.transform("kept", lambda x: x["r"])), F.lit("[]"))
    return joined.select("attachment_id", F.when(used, "used").otherwise("unused").alias("status"), F.coalesce("ref_count", F.lit(0)).alias("ref_count"), json.alias("refs_json"), F.lit(scanned_at).cast("long").alias("scanned_at"))


def known_status(status: Column) -> Column:
    """Any other stored text reads as none."""
    return F.when(status.isin(*STATUSES), status)


def decoded(results: DataFrame) -> DataFrame:
    """attachment_id, place and the stored references with their defaults; unreadable text has none."""
    found = results.select("attachment_id", F.posexplode(F.coalesce(F.from_json("refs_json", SCHEMA), F.array().cast(SCHEMA))).alias("place", "r"))
    defaults = {"d": ("detector", ""), "t": ("object_type", "post"), "i": ("object_id", 0), "k": ("detail", ""), "m": ("match", "exact"), "c": ("confidence", "possible")}
    return found.select("attachment_id", "place", *(F.coalesce(f"r.{k}", F.lit(v)).alias(name) for k, (name, v) in defaults.items()))


def status_counts(attachments: DataFrame, results: DataFrame, collation: Collation = BINARY) -> DataFrame:
    """used, unused, unscanned, total over attachments that aren't trashed, in one pass."""
    alive = attachments.where(~collation.among(F.col("post_status"), "trash")).select(F.col("id").alias("attachment_id")).join(results.select("attachment_id", "status"), "attachment_id", "left")
    counts = alive.agg(F.count_if(collation.among(F.col("status"), "used")).alias("used"), F.count_if(collation.among(F.col("status"), "unused")).alias("unused"), F.count("*").alias("total"))
    return counts.select("used", "unused", F.greatest(F.lit(0), F.col("total") - F.col("used") - F.col("unused")).alias("unscanned"), "total")


def saved(results: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored results with those of ``fresh`` put in or replaced."""
    return cleared(results, fresh).unionByName(fresh)


def latest(stored: DataFrame) -> DataFrame:
    """One verdict for each attachment, the last one, of results stored in several ``batch``es."""
    columns = [c for c in stored.columns if c not in ("attachment_id", "batch")]
    newest = stored.groupBy("attachment_id").agg(F.max_by(F.struct(*columns), F.struct("scanned_at", "batch")).alias("r"))
    return newest.select("attachment_id", "r.*")


def cleared(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored results without those of the given attachments."""
    return results.join(ids.select("attachment_id"), "attachment_id", "left_anti").select(*results.columns)
