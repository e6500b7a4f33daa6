"""Stored results and scan state: what a save touches, what readers see, two writers, writes that are cut off."""

from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from refscan.operators import state
from refscan.operators.commits import Commits, Conflict
from refscan.operators.stored import Results
from refscan.plans.scan import scan_into, scanned
from refscan.sources import fixtures
from refscan.sources.site import COLUMNS
from refscan.streaming.staleness import Marker, follow, last_change
from tests.conftest import DATA


def verdicts(spark, ids, status="used", at=1):
    return spark.createDataFrame([(i, status, 1, "[]", at) for i in ids], COLUMNS["results"])


def rows(df):
    return {r.attachment_id: (r.status, r.scanned_at) for r in df.collect()}


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    store = Results(spark, str(tmp_path), width=100)
    store.save(verdicts(spark, range(1, 1000)))
    before, seen = store.parts()[1], store.read()
    files = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "data").rglob("*.parquet")}
    store.save(verdicts(spark, [205, 207, 5000], "unused", 2).union(verdicts(spark, [205], "used", 1)))
    after = store.parts()[1]
    assert {p for p in after if after[p] != before.get(p)} == {"2", "50"}
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # nothing that readers may have is written again
    assert rows(seen) == {i: ("used", 1) for i in range(1, 1000)}
    want = {i: ("used", 1) for i in range(1, 1000)} | {i: ("unused", 2) for i in (205, 207, 5000)}
    assert rows(store.read()) == want
    store.clear(spark.createDataFrame([(i,) for i in (*range(100, 200), 7, 9999)], "attachment_id long"))
    want = {i: v for i, v in want.items() if i not in {*range(100, 200), 7}}
    assert rows(store.read()) == want and "1" not in store.parts()[1]
    store.vacuum()
    assert rows(store.read()) == want
    assert {p.parent.name for p in Path(tmp_path, "data").rglob("*.parquet")} == {f"part={p}" for p in store.parts()[1]}
    store.save(verdicts(spark, []))
    assert rows(store.read()) == want and rows(Results(spark, str(tmp_path), width=100).read()) == want
    assert Results(spark, f"{tmp_path}/none").read().count() == 0


def test_saves_that_fail_and_saves_at_once(spark, tmp_path, monkeypatch):
    one, two = Results(spark, str(tmp_path), width=100), Results(spark, str(tmp_path), width=100)
    one.save(verdicts(spark, range(1, 300)))
    add = Commits.add

    def cut_off(self, number, text):
        raise RuntimeError("gone")

    monkeypatch.setattr(Commits, "add", cut_off)
    with pytest.raises(RuntimeError):
        one.save(verdicts(spark, [5], "unused", 2))
    monkeypatch.setattr(Commits, "add", add)
    assert rows(one.read())[5] == ("used", 1)
    # The second one writes between the first one's reading and writing: the first starts again from what it wrote.
    other = iter([lambda: two.save(verdicts(spark, [6], "unused", 3))])

    def late(self, number, text):
        if between := next(other, None):
            between()
        return add(self, number, text)

    monkeypatch.setattr(Commits, "add", late)
    one.save(verdicts(spark, [7], "unused", 4))
    monkeypatch.setattr(Commits, "add", add)
    found = rows(two.read())
    assert (found[6], found[7], found[8], len(found)) == (("unused", 3), ("unused", 4), ("used", 1), 299)
    other = iter([lambda: two.save(verdicts(spark, [8], "unused", 3))])
    monkeypatch.setattr(Commits, "add", late)
    with pytest.raises(Conflict):
        one.change(fresh=verdicts(spark, [9], "unused", 4), tries=1)
    monkeypatch.setattr(Commits, "add", add)
    assert rows(one.read())[9] == ("used", 1) and rows(one.read())[8] == ("unused", 3)


def test_two_scans_at_once(spark, tmp_path):
    one, two = state.Store(spark, str(tmp_path)), state.Store(spark, str(tmp_path))
    one.start(10, 5)
    seen = one.seq()
    assert two.seq() == seen and two.advance(40, 7, 6, after=seen) == state.State(40, 7, 10, 5)
    with pytest.raises(Conflict):
        one.advance(30, 5, 6, after=seen)
    with pytest.raises(Conflict):
        one.finish(1, 6, after=seen)
    assert one.current() == state.State(40, 7, 10, 5) and one.last_scan() is None
    one.finish(2, 8)
    for i in range(60):
        two.advance(i, 1, 9)
    assert two.current().done == 60 and two.last_scan() == state.LastScan(8, 7, 2)
    assert len(list(Path(tmp_path).glob("*.json"))) <= state.KEPT_ROWS + 2 and one.log().count() <= state.KEPT_ROWS + 2
    assert state.current_of(one.log()).first().done == 60 and state.last_of(one.log()).first() == (8, 7, 2)
    Path(tmp_path, f"{one.seq() + 1:012}.json").write_text('{"kind": "runn')  # cut off
    assert one.current().done == 60
    assert two.advance(99, 1, 9).done == 61 and one.current().cursor == 99


def test_a_scan_into_stored_results(spark, tmp_path):
    site = fixtures.site(spark, f"{DATA}/sf0.001")
    store, results = state.Store(spark, f"{tmp_path}/log"), Results(spark, f"{tmp_path}/results", width=64)
    assert scan_into(site, store, results, 50, size=120).done == 120 and results.read().count() == 120
    assert scan_into(site, store, results, 50, size=120).done == 200
    end = scan_into(site, store, results, 60, size=120)
    whole = scanned(site, 50)
    assert sorted(map(tuple, results.read().collect())) == sorted(map(tuple, whole.collect()))
    alive = site.attachments.where("post_status <> 'trash'").select(F.col("id").alias("attachment_id"))
    assert end == state.LastScan(60, 200, whole.join(alive, "attachment_id").where("status = 'unused'").count())


def test_marker_of_changes(spark, tmp_path, monkeypatch):
    """It rises only, whoever writes, however often: runs that are cut off, started again, late and repeated files."""
    one, two = Marker(spark, f"{tmp_path}/m"), Marker(spark, f"{tmp_path}/m")
    assert one.value() is None and one.read().first() == (None,)
    one.raise_to(None)
    assert one.value() is None
    for value, want in ((50, 50), (40, 50), (50, 50), (70, 70)):
        one.raise_to(value)
        assert two.value() == two.read().first()[0] == want
    add = Commits.add

    def behind(self, number, text):
        """Another writer is first, with a higher value."""
        monkeypatch.setattr(Commits, "add", add)
        two.raise_to(95)
        add(self, number, text)

    monkeypatch.setattr(Commits, "add", behind)
    one.raise_to(90)
    assert one.value() == 95
    for value in range(100, 130):
        one.raise_to(value)
    assert one.value() == 129 and len(one.commits.numbers()) <= 9

    schema = "post_id long, post_type string, ts timestamp"
    change = lambda n, rows: spark.createDataFrame(rows, "post_id long, post_type string, s long").select("post_id", "post_type", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/log/{n}")
    marker = Marker(spark, f"{tmp_path}/n")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        follow(stream, marker, f"{tmp_path}/{checkpoint}").awaitTermination()

    change(0, [(1, "revision", 900), (2, "attachment", 800)])
    run("c")
    assert marker.value() is None
    change(1, [(1, "post", 300), (2, None, 950), (3, "page", None)])
    monkeypatch.setattr(Commits, "add", lambda self, number, text: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(StreamingQueryException):
        run("c")
    monkeypatch.setattr(Commits, "add", add)
    assert marker.value() is None
    run("c")
    assert marker.value() == 300
    change(2, [(5, "post", 200)])
    change(3, [(6, "post", 310), (6, "post", 310)])
    run("c")
    run("c")
    run("again")  # everything once more
    whole = last_change(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")).first()
    assert marker.read().first() == whole == (310,)
