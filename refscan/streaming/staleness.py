"""When content last changed: revisions and attachments don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commits import Commits, Conflict

#: Older values that are left for readers that have just listed them.
KEPT = 8


def epoch_seconds(changes: DataFrame) -> Column:
    """Of column ts; a time without a zone is UTC, whatever the session's zone is."""
    if changes.schema["ts"].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return F.unix_seconds("ts")


def last_change(changes: DataFrame) -> DataFrame:
    """changed_at (epoch seconds), one row; batch or stream."""
    counted = changes.where(~F.col("post_type").isin("revision", "attachment"))
    return counted.agg(F.max(epoch_seconds(counted)).alias("changed_at"))


def is_stale(changed_at: Column, scanned_at: Column) -> Column:
    return F.coalesce(changed_at > scanned_at, F.lit(False))


class Marker:
    """When content last changed, stored in a folder that all can reach (see ``commits``): it only ever rises.

    So what is put in twice, late or by two writers at once changes nothing, and readers need no stream to be running."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.commits = spark, Commits(spark, folder)

    def value(self) -> int | None:
        """Epoch seconds; none before the first change."""
        text = self.commits.last()[1]
        return None if text is None else int(text)

    def read(self) -> DataFrame:
        """changed_at, one row, as ``last_change`` gives it."""
        return self.spark.createDataFrame([(self.value(),)], "changed_at long")

    def raise_to(self, changed_at: int | None) -> None:
        while changed_at is not None:
            number, text = self.commits.last()
            if text is not None and int(text) >= changed_at:
                return
            try:
                self.commits.add(number + 1, str(changed_at))
            except Conflict:
                continue  # another writer's value may be the higher one
            self.commits.drop([n for n in self.commits.numbers() if n <= number - KEPT])
            return


def follow(changes: DataFrame, marker: Marker, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps ``marker`` at the last change of a stream, over what is there now (or by another trigger); run again to go on.

    Each micro-batch gives one number, by partial maxima on its tasks; the stream itself has no state. A batch that is
    run again after a failure gives the same number, so the marker is right wherever a run was cut off."""

    def each(batch: DataFrame, _: int) -> None:
        marker.raise_to(last_change(batch).first()["changed_at"])

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
