"""Stored results: a table in parts by ranges of ids, of which a save rewrites only those that it touches.

The parts that count are listed in numbered files (see ``commits``). A save writes new parts beside the old ones, then
one more list: readers have all of the old parts or all of the new ones, a save that is cut off leaves the old ones, and
of two saves at once the second one fails, or starts again from what the first one wrote."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.site import COLUMNS
from .commits import Commits, Conflict

#: Ids of a part.
WIDTH = 100_000


class Results:
    def __init__(self, spark: SparkSession, folder: str, width: int = WIDTH):
        self.spark, self.folder, self.width = spark, folder, width
        self.commits = Commits(spark, f"{folder}/lists")
        self.columns = [c.split()[0] for c in COLUMNS["results"].split(", ")]

    def parts(self) -> tuple[int, dict[str, str]]:
        """The last list's number, and the save that each part is of, by part."""
        number, text = self.commits.last()
        return number, json.loads(text) if text else {}

    def read(self) -> DataFrame:
        """attachment_id, status, ref_count, refs_json, scanned_at: the results as they are now; later saves don't change what was read."""
        return self.of(self.parts()[1])

    def of(self, parts: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/data/save={save}/part={part}" for part, save in sorted(parts.items())]
        reader = self.spark.read.schema(COLUMNS["results"])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], COLUMNS["results"])

    def change(self, fresh: DataFrame | None = None, gone: DataFrame | None = None, tries: int = 3) -> None:
        """Puts results in or replaces them, and takes those of ids (attachment_id) away.

        Of repeated ids in ``fresh`` the last scan counts."""
        part = F.floor(F.col("attachment_id") / self.width).cast("string")
        for left in reversed(range(tries)):
            number, parts = self.parts()
            save = uuid.uuid4().hex
            new = self.spark.createDataFrame([], f"{COLUMNS['results']}, keep boolean")
            if fresh is not None:
                new = fresh.groupBy("attachment_id").agg(F.max_by(F.struct(*self.columns[1:]), F.coalesce("scanned_at", F.lit(0))).alias("r")).select("attachment_id", "r.*", F.lit(True).alias("keep"))
            if gone is not None:
                none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in COLUMNS["results"].split(", ")[1:]]
                own = gone.select("attachment_id").distinct().select("attachment_id", *none, F.lit(False).alias("keep"))
                new = new.unionByName(own.join(new.select("attachment_id"), "attachment_id", "left_anti"))
            changes = f"{self.folder}/data/changes={save}"
            new.withColumn("part", part).write.partitionBy("part").parquet(changes)  # computed once; says which parts are touched
            new = self.spark.read.schema(f"{COLUMNS['results']}, keep boolean, part string").parquet(changes)
            touched = sorted(r["part"] for r in new.select("part").distinct().collect())  # as many as ranges of ids
            if not touched:
                self.commits.delete(f"../data/changes={save}")
                return
            old = self.of({p: s for p, s in parts.items() if p in touched}).join(new.select("attachment_id"), "attachment_id", "left_anti")
            rows = old.withColumn("part", part).unionByName(new.where("keep").drop("keep"))
            rows.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/data/save={save}")
            own = {r["part"] for r in self.spark.read.schema("part string").option("basePath", f"{self.folder}/data/save={save}").parquet(f"{self.folder}/data/save={save}").distinct().collect()}
            self.commits.delete(f"../data/changes={save}")
            listed = {p: s for p, s in parts.items() if p not in touched} | dict.fromkeys(own, save)
            try:
                return self.commits.add(number + 1, json.dumps(listed))
            except Conflict:
                self.commits.delete(f"../data/save={save}")
                if not left:
                    raise

    def save(self, fresh: DataFrame) -> None:
        self.change(fresh=fresh)

    def clear(self, ids: DataFrame) -> None:
        self.change(gone=ids)

    def vacuum(self, lists: int = 1) -> None:
        """Deletes parts and lists that aren't of the last ``lists`` lists: nobody may read older ones any more."""
        numbers = self.commits.numbers()
        kept = {(p, s) for n in numbers[-lists:] if (t := self.commits.text(n)) for p, s in json.loads(t).items()}
        old = {(p, s) for n in numbers[:-lists] if (t := self.commits.text(n)) for p, s in json.loads(t).items()} - kept
        for p, s in old:
            self.commits.delete(f"../data/save={s}/part={p}")
        self.commits.drop(numbers[:-lists])
