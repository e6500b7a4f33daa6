"""Deletion of unused attachments, each checked again first."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.site import Site
from .lineage import cut
from .listing import ranked, unused_ids
from .results import cleared, verdicts

LARGEST = (1 << 63) - 1


#: A number that a text begins with.
NUMBER = re.compile(r"[ \t\n\r\v\f]*[+-]?([0-9]+(?:\.[0-9]*)?|\.[0-9]+)((?:[eE][+-]?[0-9]+)?)")


def requested(ids: Iterable[int | str | None]) -> list[int]:
    """Ids as given by a form: absolute values of the numbers that texts begin with (1e3 is 1000), without fractions and zeros, repeats kept.

    A number beyond a long is one that no attachment has."""
    out = []
    for x in ids:
        found = NUMBER.match(str(x or ""))
        number, power = found.groups() if found else ("0", "")
        if not power and "." not in number:
            value = int(number)
        else:
            value = float(number + power)
            value = int(value) if value < LARGEST else LARGEST
        out.append(min(value, LARGEST))
    return [x for x in out if x]


def key(text: str | None) -> str:
    """A key as given by a form: lower case, without anything but a to z, digits, dashes and underscores."""
    return "".join(c for c in (text or "").lower() if c.isascii() and (c.isalnum() or c in "-_"))


def requested_keys(texts: Column) -> Column:
    """``key`` of a column."""
    return F.regexp_replace(F.lower(F.coalesce(texts, F.lit(""))), "[^a-z0-9_-]", "")


def numbered(ids: DataFrame) -> DataFrame:
    """n, attachment_id: requests in ascending order of ids."""
    return ranked(ids.select("attachment_id"), "attachment_id").select(F.col("rank").cast("long").alias("n"), "attachment_id")


def plan(site: Site, requests: DataFrame, refs: DataFrame, deletable: DataFrame, fails: DataFrame | None = None) -> DataFrame:
    """n, attachment_id, outcome for each row of ``requests`` (n, attachment_id), which are carried out by n.

    failed: no attachment (any more), not in ``deletable``, or one of ``fails``, whose deletion goes wrong; skipped: used at its turn;
    deleted. ``refs``: references of these attachments on the site as it is before. A deletion takes the references in its
    attachment's own meta rows with it: what only those mention is unused at a later turn, so it can go, too; what they
    mention at an earlier turn is still used. This is settled in rounds: an attachment's turn comes when all that mention it are gone."""
    known = site.attachments.select(F.col("id").alias("attachment_id"))
    may = known.join(deletable.select("attachment_id").distinct(), "attachment_id", "left_semi").withColumn("may", F.lit(True))
    asked = requests.select("n", "attachment_id").join(may, "attachment_id", "left")
    if fails is not None:
        asked = asked.join(fails.select("attachment_id", F.lit(True).alias("fails")).distinct(), "attachment_id", "left")
    else:
        asked = asked.withColumn("fails", F.lit(None).cast("boolean"))
    asked = cut(asked)
    turns = asked.where("may").select("attachment_id", "n")
    leaves = asked.where("may AND fails IS NULL").select(F.col("attachment_id").alias("holder"), F.lit(True).alias("leaves")).distinct()
    counting = refs.where("confidence <> 'info'").select("attachment_id", held_by().alias("holder")).distinct().join(turns, "attachment_id", "left_semi")
    held = cut(counting.join(leaves, "holder", "left"))
    kept = held.where("leaves IS NULL").select("attachment_id").distinct()  # mentioned by what stays
    edges = held.join(kept, "attachment_id", "left_anti").select("attachment_id", "holder")
    needs = edges.groupBy("attachment_id").agg(F.count("*").alias("needed"))
    unused = cut(turns.join(held.select("attachment_id").distinct(), "attachment_id", "left_anti").groupBy("attachment_id").agg(F.min("n").alias("turn")))
    while True:
        gone = unused.join(leaves.withColumnRenamed("holder", "attachment_id"), "attachment_id").select(F.col("attachment_id").alias("holder"), "turn")
        free = edges.join(gone, "holder").groupBy("attachment_id").agg(F.count("*").alias("n_gone"), F.max("turn").alias("after")).join(needs, "attachment_id").where("n_gone = needed")
        next_ = free.join(turns, "attachment_id").where("n > after").groupBy("attachment_id").agg(F.min("n").alias("turn")).join(unused.select("attachment_id"), "attachment_id", "left_anti")
        if (next_ := cut(next_)).isEmpty():
            break
        unused = cut(unused.unionByName(next_))
    outcome = F.when(F.col("may").isNull(), "failed").when(F.col("turn").isNull() | (F.col("n") < F.col("turn")), "skipped").when(F.col("fails") | (F.col("n") > F.col("turn")), "failed").otherwise("deleted")
    return asked.join(unused, "attachment_id", "left").select("n", "attachment_id", outcome.alias("outcome"))


def held_by() -> Column:
    """The post or attachment that holds a reference; the others never go."""
    return F.when(F.col("object_type") == "post", F.col("object_id"))


def tried(site: Site, contexts: DataFrame, requests: DataFrame, refs: DataFrame, deletable: DataFrame, now: int, fails: DataFrame | None = None) -> DataFrame:
    """The ``plan`` with the verdict that each skipped request stored: status, ref_count, refs_json, scanned_at, on what was left at its turn."""
    outcomes = cut(plan(site, requests, refs, deletable, fails))
    gone = outcomes.where("outcome = 'deleted'").select(F.col("attachment_id").alias("holder"), F.col("n").alias("turn"))
    skipped = outcomes.where("outcome = 'skipped'")
    # A request is an attachment of its own here: an id may be asked for several times.
    left = refs.withColumn("holder", held_by()).join(gone, "holder", "left").join(skipped.select("n", "attachment_id"), "attachment_id").where("turn IS NULL OR turn > n")
    seen = verdicts(skipped.select(F.col("n").alias("attachment_id")), left.drop("attachment_id").withColumnRenamed("n", "attachment_id"), now)
    return outcomes.join(seen.withColumnRenamed("attachment_id", "n"), "n", "left")


def tally(outcomes: DataFrame) -> DataFrame:
    """deleted, skipped, failed."""
    return outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("deleted", "skipped", "failed")))


def next_batch(site: Site, n: int | None = 5) -> DataFrame:
    """The unused attachments of the next deletion batch, or all that are left; every outcome takes them out of the pool."""
    return unused_ids(site, n)


def applied(site: Site, done: DataFrame) -> Site:
    """The site after requests that were ``tried``: deleted attachments go with their meta rows and results, results of failed ones are cleared, of skipped ones renewed.

    A row of ``done`` that comes later (by n) counts more."""
    last = done.groupBy("attachment_id").agg(F.max_by(F.struct("outcome", "status", "ref_count", "refs_json", "scanned_at"), "n").alias("r"), F.bool_or(F.col("outcome") == "deleted").alias("gone")).select("attachment_id", "gone", "r.*")
    gone = last.where("gone").select("attachment_id")
    without = lambda df, column: df.join(gone.withColumnRenamed("attachment_id", column), column, "left_anti").select(*df.columns)
    renewed = last.where("NOT gone AND outcome = 'skipped'").select(*site.results.columns)
    return replace(site, attachments=without(site.attachments, "id"), postmeta=without(site.postmeta, "post_id"), results=cleared(site.results, last).unionByName(renewed))


def uninstalled(site: Site) -> tuple[DataFrame, DataFrame]:
    """Options and postmeta without anything of our own; content stays."""
    own_options = F.col("option_name").isin("refscan_scan_state", "refscan_last_scan", "refscan_changed_at")
    own_keys = F.col("meta_key").isin("_refscan_status", "_refscan_refs", "_refscan_scanned_at")
    return site.options.where(~own_options), site.postmeta.where(F.coalesce(~own_keys, F.lit(True)))
