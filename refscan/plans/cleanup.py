"""Deletion of all that is unused, in rounds that can be stopped and taken up again.

Each round takes the lowest unused ids, verifies them again on the site as all rounds before have left it, and stores what
came of each in a folder of its own. The site's tables are never rewritten: what the rounds have stored, put onto
them, is the site afterwards. A round that is cut off leaves no complete folder and is done again.

Reading the site's texts takes the same time for a round's ids as for all. So rounds that follow one another share one reading: what
comes of all that is unused is settled at once, in the order of requests, and each round stores its part of it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from time import monotonic

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deletion
from ..operators.commits import Commits
from ..operators.lineage import cut, shared_dir
from ..sources.site import Site
from .scan import chosen, references

#: What came of each request; n counts through all rounds.
OUTCOMES = "n long, attachment_id long, outcome string, status string, ref_count long, refs_json string, scanned_at long"
COLUMNS = [c.split()[0] for c in OUTCOMES.split(", ")]
BATCH = 5


def outcomes(site: Site, folder: str) -> DataFrame:
    """All that the rounds have stored so far."""
    spark, schema = site.posts.sparkSession, f"{OUTCOMES}, round long"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:  # no round yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def after(site: Site, folder: str) -> Site:
    """The site as the rounds have left it."""
    return deletion.applied(site, outcomes(site, folder))


def reached(before: DataFrame) -> tuple[int, int]:
    """The next round's number, and the last request's."""
    at = before.agg(F.coalesce(F.max("round") + 1, F.lit(0)).alias("round"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
    return at["round"], at["n"]


def verified(site: Site, before: DataFrame, ids: DataFrame, current: Site, deletable: DataFrame, now: int, n: int, fails: DataFrame | None) -> DataFrame:
    """What comes of requests for the ids, numbered from n + 1, on the site as it is after what was done ``before``."""
    requests = deletion.numbered(ids).withColumn("n", F.col("n") + n)
    gone = before.where("outcome = 'deleted'").select(F.col("attachment_id").alias("holder"))
    # What is gone holds nothing any more, as within a round, also where its id is a post's as well.
    refs = cut(references(current, ids).withColumn("holder", deletion.held_by()).join(gone, "holder", "left_anti").drop("holder"))  # for the plan and for verdicts
    done = deletion.tried(current, chosen(current, ids), requests, refs, deletable, now, fails)
    return done.select(*COLUMNS)


def stored(done: DataFrame, folder: str, number: int) -> dict[str, int]:
    """Stores a round; its tally."""
    place = f"{folder}/round={number}"
    done.write.mode("overwrite").parquet(place)
    return deletion.tally(done.sparkSession.read.schema(OUTCOMES).parquet(place)).first().asDict()


def delete_round(site: Site, folder: str, deletable: DataFrame, now: int, size: int = BATCH, fails: DataFrame | None = None) -> dict[str, int] | None:
    """One round: how many were deleted, skipped and failed, or None if nothing unused is left.

    Every outcome takes an id out of the pool: what is deleted is no attachment any more, what is skipped is stored as used, and what
    failed has no stored result. So there are no more rounds than unused attachments at the start."""
    before = cut(outcomes(site, folder))  # read to the end: a round that was cut off may be overwritten
    number, n = reached(before)
    current = deletion.applied(site, before)
    ids = cut(deletion.next_batch(current, size))
    if ids.isEmpty():
        return None
    return stored(verified(site, before, ids, current, deletable, now, n, fails), folder, number)


def delete_unused(site: Site, folder: str, deletable: DataFrame, now: int, size: int = BATCH, fails: DataFrame | None = None) -> Iterator[dict[str, int]]:
    """Rounds until nothing unused is left, each one's tally as it is done.

    They share what was read of the site for as long as reading it took: a round that begins later reads it again, so that
    no verification is much older than one of the round's own would be. So does a round before which another caller has stored one."""
    if size < 1:
        raise ValueError("a round has one request or more")
    spark = site.posts.sparkSession
    scratch = Commits(spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}")
    ahead, place, at, until = 0, "", (0, 0), 0.0
    try:
        while True:
            if ahead == 0 or monotonic() > until or reached(outcomes(site, folder)) != at:
                began = monotonic()
                before = cut(outcomes(site, folder))
                at = reached(before)
                current = deletion.applied(site, before)
                ids = cut(deletion.next_batch(current, None))
                if (ahead := ids.count()) == 0:
                    return
                place = uuid.uuid4().hex
                done = verified(site, before, ids, current, deletable, now, at[1], fails)
                done.repartitionByRange("n").sortWithinPartitions("n").write.parquet(f"{scratch.folder}/{place}")  # a round reads its own rows of it
                until = 2 * monotonic() - began
            number, n = at
            part = spark.read.schema(OUTCOMES).parquet(f"{scratch.folder}/{place}").where(F.col("n").between(n + 1, n + size))
            said = stored(part, folder, number)
            at, ahead = (number + 1, min(n + size, n + ahead)), max(0, ahead - size)
            yield said
    finally:
        scratch.delete("")
