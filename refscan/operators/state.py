"""A scan that can be stopped and resumed: its state is a row of a log, read and written between batches.

The last row of the log counts, so a write that is cut off leaves the state before it."""

from __future__ import annotations

import json
from dataclasses import asdict, astuple, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.site import Site
from .commits import Commits
from .listing import ids_after, ranked

LOG = "seq long, kind string, cursor long, done long, total long, started_at long, finished_at long, scanned long, unused long"
BATCH = 10
#: Rows of a stored log that are kept besides the last finished scan.
KEPT_ROWS = 16


@dataclass(frozen=True)
class State:
    cursor: int = 0
    done: int = 0
    total: int = 0
    started_at: int = 0


@dataclass(frozen=True)
class LastScan:
    finished_at: int
    scanned: int
    unused: int


def started(total: int, now: int) -> State:
    return State(0, 0, total, now)


def advanced(state: State | None, cursor: int, n: int, now: int) -> State:
    """The batch's last id becomes the cursor; a missing state is started first."""
    state = state or started(0, now)
    return replace(state, cursor=cursor, done=state.done + n)


def finished(state: State | None, unused: int, now: int) -> tuple[None, LastScan]:
    """The state goes, the last scan stays."""
    return None, LastScan(now, state.done if state else 0, unused)


def total_shown(state: State) -> int:
    """Attachments that come during a scan can exceed the total at its start."""
    return max(state.total, state.done)


def progress(done: int, total: int) -> int:
    """Percent, halves up, 100 at most, 0 of nothing."""
    return min(100, int(100 * done / total + 0.5)) if total else 0


def percent(done: Column, total: Column) -> Column:
    """``progress`` of columns."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(100 * done / total + 0.5))).otherwise(0).cast("long")


def goal_shown(done: Column, total: Column) -> Column:
    """``total_shown`` of columns."""
    return F.greatest(total, done).cast("long")


def current_of(log: DataFrame) -> DataFrame:
    """cursor, done, total, started_at of a running scan: one row, or none after a reset, an end, or nothing at all."""
    last = log.agg(F.max_by(F.struct("kind", "cursor", "done", "total", "started_at"), "seq").alias("r")).select("r.*")
    return last.where("kind = 'running'").drop("kind")


def last_of(log: DataFrame) -> DataFrame:
    """finished_at, scanned, unused of the last finished scan, which a reset leaves: one row or none."""
    last = log.where("kind = 'finished'").agg(F.max_by(F.struct("finished_at", "scanned", "unused"), "seq").alias("r")).select("r.*")
    return last.where("finished_at IS NOT NULL")


def with_row(log: DataFrame, kind: str, state: State | None = None, last: LastScan | None = None) -> DataFrame:
    """The log with one more row at its end: kind running, finished or reset."""
    values = (*(astuple(state) if state else (None,) * 4), *(astuple(last) if last else (None,) * 3))
    row = log.sparkSession.createDataFrame([(kind, *values)], LOG.split(", ", 1)[1])
    end = log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    return log.unionByName(row.withColumn("one", F.lit(1)).join(F.broadcast(end.withColumn("one", F.lit(1))), "one").drop("one"))  # one row each


class Store:
    """The log in a folder that all can reach: each row is a numbered file, which one writer makes.

    A writer that has not read what another one has written since gets a ``commits.Conflict`` and changes nothing. Of rows before
    the last ones only the last finished scan is kept, so the log stays short."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.commits = spark, Commits(spark, folder)

    def rows(self) -> list[tuple[int, dict]]:
        return [(n, json.loads(t)) for n in self.commits.numbers() if (t := self.commits.text(n)) is not None]

    def log(self) -> DataFrame:
        names = [c.split()[0] for c in LOG.split(", ")]
        return self.spark.createDataFrame([tuple({"seq": n, **row}.get(c) for c in names) for n, row in self.rows()], LOG)

    def seq(self) -> int:
        """The number of the last row: what a later write may be made to follow."""
        return max(self.commits.numbers(), default=0)

    def append(self, kind: str, state: State | None = None, last: LastScan | None = None, after: int | None = None) -> None:
        rows = self.rows()
        seq = self.seq() if after is None else after
        self.commits.add(seq + 1, json.dumps({"kind": kind} | (asdict(state) if state else {}) | (asdict(last) if last else {})))
        finished = [n for n, row in rows if row["kind"] == "finished"]
        self.commits.drop([n for n, _ in rows[:-KEPT_ROWS] if n not in finished[-1:]])

    def current(self) -> State | None:
        rows = self.rows()
        if not rows or rows[-1][1]["kind"] != "running":
            return None
        return State(*(rows[-1][1][f.name] for f in fields(State)))

    def last_scan(self) -> LastScan | None:
        done = [row for _, row in self.rows() if row["kind"] == "finished"]
        return LastScan(*(done[-1][f.name] for f in fields(LastScan))) if done else None

    def start(self, total: int, now: int, after: int | None = None) -> State:
        self.append("running", state := started(total, now), after=after)
        return state

    def advance(self, cursor: int, n: int, now: int, after: int | None = None) -> State:
        after = self.seq() if after is None else after
        self.append("running", state := advanced(self.current(), cursor, n, now), after=after)
        return state

    def finish(self, unused: int, now: int, after: int | None = None) -> LastScan:
        after = self.seq() if after is None else after
        _, last = finished(self.current(), unused, now)
        self.append("finished", last=last, after=after)
        return last

    def reset(self) -> None:
        """Forgets the running scan; the last finished one stays."""
        self.append("reset")


def batches(site: Site, size: int = BATCH) -> DataFrame:
    """batch, cursor, done: what a scan in batches goes through; each row is a written state."""
    size = max(1, size)
    return ranked(site.attachments.select("id"), "id").groupBy(F.floor((F.col("rank") - 1) / size).alias("batch")).agg(F.max("id").alias("cursor"), F.max("rank").alias("done"))


def next_batch(site: Site, state: State, size: int = BATCH) -> DataFrame:
    return ids_after(site.attachments, state.cursor, size)
