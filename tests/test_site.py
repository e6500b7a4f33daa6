"""A small hand-made site: contexts, every case of the detectors, verdicts, deletion, state and streams."""

import json
import re

import pytest
from pyspark.sql import functions as F

from refscan.operators import deletion, detectors, listing, results, state
from refscan.operators.candidates import name_pairs
from refscan.operators.context import contexts
from refscan.functions import labels
from refscan.plans import cleanup
from refscan.plans.scan import chosen, merged, needles_of, references, scan_batch, scanned, scanned_few
from refscan.sources.site import COLUMNS, Site, read
from refscan.streaming import batches, staleness

ATTACHMENTS = [
    (123, "inherit", 7, "Hero", "image/jpeg", "2026/07/hero-scaled.jpg", "hero.jpg", [("medium", ("hero-300x200.jpg",)), ("thumbnail", ("hero-150x150.jpg",))], 10),
    (4, "private", 8, "", "image/png", "a/b.png", None, None, None),
    (5, "trash", 9, "", "image/png", "", "", [], None),
    (6, "inherit", 77, None, None, None, None, None, None),
]
POSTS = [(7, "post", "publish", "Seven", "none"), (8, "revision", "publish", "", "[1,123,9]"), (9, "page", "trash", "", "see superhero.jpg"), (20, "post", "auto-draft", "", "wp-image-123"), (21, "post", "publish", "", "wp-image-123 and wp-image-4"), (22, "post", "trash", "", '<!-- {"id":123} -->'), (23, "post", "publish", "", '"ids":[4, 123, 9]'), (24, "page", "publish", "", '"ids":[4,123,9]')]
META = [
    (1, 7, "_thumbnail_id", "123"), (2, 7, "_product_image_gallery", "4,123,9"), (3, 7, "_elementor_data", '[{"id":123}]'), (4, 7, "_elementor_data", "123"), (5, 7, "hero", "123"), (6, 7, "_hero", "field_1"), (7, 7, "_hero", "other"),
    (8, 9, "_thumbnail_id", "123"), (9, 8, "x", "123"), (10, 123, "x", "123"), (11, 999, "x", "123"), (12, 7, None, "123"), (13, 7, "_edit_lock", "123"), (14, 7, "plain", "123"), (15, 7, "list", "4,123, 9"), (16, 7, "ser", 'a:1:{i:0;s:3:"123";}'),
    (17, 7, "json", '{"id": 123}'), (18, 7, "json2", '{"id": 123} {"id":1234}'), (19, 7, "file", "/x/hero-300x200.jpg"), (20, 7, "gap", " 123"), (21, 20, "late", "123"), (22, 4, "other", "123"), (23, 7, "_refscan_x", "123"), (24, 7, "null", None),
]
OPTIONS = [
    (1, "site_icon", "123"), (2, "theme_mods_a", 'a:1:{s:4:"logo";i:123;}'), (3, "theme_mods_b", "a:1:{i:123;i:0;}"), (4, "widget_a", "a:1:{i:123;i:0;}"), (5, "widget_b", "a:1:{i:0;i:123;}"), (6, "opt", "4,123,9"), (7, "opt2", "a:1:{i:0;i:123;}"),
    (8, "opt3", "a:1:{i:123;i:0;}"), (9, "opt4", '{"id":123}'), (10, "opt5", "x hero.jpg"), (11, "_transient_x", "123"), (12, "cron", "123"), (13, "widget_c", 's:13:"x "id":123 yz";'), (14, "opt6", "123"),
]


@pytest.fixture(scope="module")
def site(spark):
    rows = {
        "attachments": [(*a, None) for a in ATTACHMENTS], "posts": POSTS, "postmeta": META, "options": OPTIONS,
        "termmeta": [(1, 1, "image", "123"), (2, 1, "_image", "field_x"), (3, 2, None, "123"), (4, 3, "u", "hero.jpg")], "usermeta": [(1, 1, "a", "123"), (2, 1, "wp_capabilities", "123"), (3, 1, None, "123"), (4, 1, "session_tokens", "123"), (5, 2, "ids", "123,7")],
        "terms": [(1, "Term")], "users": [(2, "Ann")], "files": [(123, 99)], "scan_log": [], "results": [(4, "unused", 0, "[]", 5), (123, "garbage", 3, "x", 6), (99, "used", 1, "[]", 7)], "changes": [],
    }
    frames = {name: spark.createDataFrame(rows[name], schema.replace("map<string,struct<file:string>>", "array<struct<key:string,value:struct<file:string>>>")) for name, schema in COLUMNS.items()}
    # Sizes are pairs first: a Python dict would lose its order on the way.
    return Site(**frames | {"attachments": frames["attachments"].withColumn("sizes", F.map_from_entries("sizes"))})


def metrics(plan):
    """Output rows of all nodes of a plan that has run."""
    final = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    out, todo = [], [final]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if node.metrics().contains("numOutputRows"):
            out.append(f"number of output rows: {node.metrics().apply('numOutputRows').value()}")
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.length())]
    return "\n".join(out)


def refs(site, name, attachment=123):
    found = detectors.DETECTORS[name](site, contexts(site.attachments)).where(F.col("attachment_id") == attachment).collect()
    return sorted((r.object_type, r.object_id, r.detail, r.match, r.confidence) for r in found)


def test_contexts(site):
    got = {r.attachment_id: r for r in contexts(site.attachments).collect()}
    assert got[123].basenames == ["hero-scaled.jpg", "hero.jpg", "hero-300x200.jpg", "hero-150x150.jpg"] and got[123].parent_id == 7
    assert got[4].basenames == ["b.png"] and got[5].basenames == [] and got[6].basenames == []


def test_postmeta(site):
    post = lambda i, *x: ("post", i, *x)
    assert refs(site, "postmeta") == sorted([
        post(7, "_thumbnail_id", "thumbnail", "confirmed"), post(7, "_product_image_gallery", "woo-gallery", "confirmed"), post(7, "_elementor_data", "elementor", "confirmed"), post(7, "hero", "acf", "confirmed"), post(9, "_thumbnail_id", "thumbnail", "possible"),
        post(7, "plain", "exact", "possible"), post(7, "list", "comma-list", "possible"), post(7, "ser", "serialized", "possible"), post(7, "json2", "block-id", "possible"), post(7, "file", "url", "confirmed"), post(20, "late", "exact", "possible"), post(4, "other", "exact", "possible"),
    ])


def test_content(site):
    assert refs(site, "content") == [("post", 9, "url", "url", "possible"), ("post", 21, "wp-image-class", "wp-image-class", "confirmed"), ("post", 22, "block-id", "block-id", "possible"), ("post", 24, "gallery", "gallery", "confirmed")]
    # The spaced list is no candidate for 123, but it is one for 4, which stands right after the bracket.
    assert refs(site, "content", 4) == [("post", 21, "wp-image-class", "wp-image-class", "confirmed"), ("post", 23, "gallery", "gallery", "confirmed"), ("post", 24, "gallery", "gallery", "confirmed")]


def test_options(site):
    assert refs(site, "options") == sorted([
        ("option", 0, "site_icon", "site-option", "confirmed"), ("theme_mod", 0, "theme_mods_a", "theme-mod", "confirmed"), ("option", 0, "widget_a", "widget", "possible"), ("option", 0, "widget_b", "widget", "confirmed"), ("option", 0, "opt2", "serialized", "possible"),
        ("option", 0, "opt4", "exact", "possible"), ("option", 0, "opt5", "url", "confirmed"), ("option", 0, "opt6", "exact", "possible"),
    ])


def test_term_user_and_parent(site):
    assert refs(site, "termmeta") == [("term", 1, "image", "acf", "confirmed"), ("term", 2, "", "exact", "possible"), ("term", 3, "u", "url", "confirmed")]
    assert refs(site, "usermeta") == [("user", 1, "a", "exact", "possible"), ("user", 2, "ids", "comma-list", "possible")]
    assert refs(site, "attached") == [("post", 7, "post_parent", "attached", "info")]
    assert refs(site, "attached", 4) == [] and refs(site, "attached", 5) == [("post", 9, "post_parent", "attached", "info")] and refs(site, "attached", 6) == []


def test_verdicts_and_hooks(site):
    got = {r.attachment_id: r for r in scanned(site, 50).collect()}
    assert {i: r.status for i, r in got.items()} == {123: "used", 4: "used", 5: "unused", 6: "unused"}
    assert got[5].ref_count == 1 and got[123].ref_count == references(site).where("attachment_id = 123").count() > 20
    kept = json.loads(got[123].refs_json)
    assert len(kept) == 20 and kept[0]["d"] == "postmeta" and set(kept[0]) == set("dtikmc")
    only = scanned(site, 50, detectors={"attached": detectors.attached}, is_used=lambda used, rows: used | (F.col("ref_count") > 0))
    assert {r.attachment_id: r.status for r in only.collect()} == {123: "used", 4: "unused", 5: "used", 6: "unused"}


def test_lists_and_store(site):
    assert results.status_counts(site.attachments, site.results).first() == (0, 1, 2, 3)
    assert sorted(r[0] for r in listing.filtered(site, "unscanned").collect()) == [5, 6]
    assert [r[0] for r in listing.unused_page(site, 0).collect()] == [4] and listing.unused_page(site, 2).count() == 0
    assert [r[0] for r in listing.ids_after(site.attachments, 4, 0).collect()] == [5]
    one = listing.usage_column(site).where("attachment_id = 123").first()
    assert (one.status, one.shown, one.badge) == (None, 0, "Not scanned")
    lines = {r.evidence for r in listing.evidence(site, references(site)).collect()}
    assert {"ACF field — Term image", "ID list — Ann ids (possible)", "Customizer setting — Customizer", "Uploaded to — Seven post_parent (record only — not a content reference)", "Gallery — #24"} <= lines
    stored = site.results.limit(0).unionByName(site.results.sparkSession.createDataFrame([(1, "used", 1, '[{"d":"x"}]', 1), (2, "used", 1, "nonsense", 1), (3, "used", 0, None, 1)], COLUMNS["results"]))
    assert [tuple(r) for r in results.decoded(stored).collect()] == [(1, 0, "x", "post", 0, "", "exact", "possible")]


def deleted(site, ids, deletable, fails=None):
    """Outcomes by n, and the site afterwards."""
    spark = site.posts.sparkSession
    requests = spark.createDataFrame(list(enumerate(ids, 1)), "n long, attachment_id long")
    own = requests.select("attachment_id").distinct()
    frame = lambda x: spark.createDataFrame([(i,) for i in x], "attachment_id long")
    done = deletion.tried(site, chosen(site, own), requests, references(site, own), frame(deletable), 60, frame(fails) if fails else None).cache()
    return [r.outcome for r in done.orderBy("n").collect()], done, deletion.applied(site, done)


def test_requests():
    assert deletion.requested(["12x", -3, None, "0", "", "12x"]) == [12, 3, 12]
    assert deletion.requested(["1e3", " 7.9", "+5", ".5e1", "²", "1e", "1e999", "9" * 30, "--4", "0x1A", 12.0]) == [1000, 7, 5, 5, 1, 2**63 - 1, 2**63 - 1, 12]


def test_deletion(site):
    outcomes, done, left = deleted(site, [123, 4, 5, 6, 6, 1000], [123, 5, 6, 1000])
    assert outcomes == ["skipped", "failed", "deleted", "deleted", "failed", "failed"]  # the second 6 is no attachment any more
    assert deletion.tally(done).first() == (2, 1, 3)
    assert sorted(r.id for r in left.attachments.collect()) == [4, 123]
    assert sorted((r.attachment_id, r.status) for r in left.results.collect()) == [(99, "used"), (123, "used")]
    bare = deletion.uninstalled(site)
    assert bare[0].count() == len(OPTIONS) and bare[1].count() == len(META)


def chain(site, meta, ids=(1, 2, 3, 4)):
    """Attachments that only meta rows of other attachments mention."""
    spark = site.posts.sparkSession
    empty = {k: getattr(site, k).limit(0) for k in ("posts", "options", "termmeta", "usermeta", "results")}
    attachments = [(i, "inherit", 0, "", "", f"f{i}.png", None, None, None, None) for i in ids]
    rows = [(n, *m) for n, m in enumerate(meta)]
    return Site(**{k: getattr(site, k) for k in COLUMNS} | empty | {"attachments": spark.createDataFrame(attachments, COLUMNS["attachments"]), "postmeta": spark.createDataFrame(rows, COLUMNS["postmeta"])})


def test_deletion_has_an_order(site):
    """What only a deleted attachment mentioned can go after it, not before it."""
    # 2 is mentioned by 1, 3 by 2, 4 by 3 and by itself.
    one = chain(site, [(1, "x", "2"), (2, "x", "see f3.png"), (3, "x", "4"), (4, "x", "4")])
    every = [1, 2, 3, 4]
    assert deleted(one, [1, 2, 3, 4], every)[0] == ["deleted"] * 4
    assert deleted(one, [4, 3, 2, 1], every)[0] == ["skipped", "skipped", "skipped", "deleted"]
    outcomes, done, left = deleted(one, [2, 1, 2, 3, 4, 2], every)
    assert outcomes == ["skipped", "deleted", "deleted", "deleted", "deleted", "failed"]
    assert left.attachments.count() == 0 and left.postmeta.count() == 0 and left.results.count() == 0
    assert deleted(one, [1, 2, 3], [1, 3])[0] == ["deleted", "failed", "skipped"]  # 2 stays, and what it mentions
    outcomes, done, left = deleted(one, [1, 2, 2, 3, 4], every, fails=[2])
    assert outcomes == ["deleted", "failed", "failed", "skipped", "skipped"]
    assert {(r.attachment_id, r.status, r.ref_count) for r in left.results.collect()} == {(3, "used", 1), (4, "used", 1)}
    # Two that mention each other stay; references that are left are counted at each turn.
    two = chain(site, [(1, "x", "2"), (2, "x", "1"), (3, "x", "2"), (3, "y", "1")])
    outcomes, done, left = deleted(two, [1, 3, 1, 2], every)
    assert outcomes == ["skipped", "deleted", "skipped", "skipped"] and [r.ref_count for r in done.orderBy("n").collect()] == [2, None, 1, 1]
    assert {(r.attachment_id, r.ref_count) for r in left.results.collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("size", [2, 100])
def test_rounds_of_deletion(site, tmp_path, size):
    """Any size of rounds comes to the same end, also if a round is cut off."""
    one = chain(site, [(1, "x", "2"), (2, "x", "3"), (9, "x", "5"), (7, "x", "6")], ids=range(1, 10))
    spark = site.posts.sparkSession
    results = spark.createDataFrame([(i, "unused", 0, "[]", 5) for i in (1, 2, 3, 5, 6, 7)] + [(9, "used", 1, "[]", 5)], COLUMNS["results"])
    one = Site(**{k: getattr(one, k) for k in COLUMNS} | {"results": results})
    may = one.attachments.select(F.col("id").alias("attachment_id"))
    rounds, folder = cleanup.delete_unused(one, str(tmp_path), may, 60, size), str(tmp_path)
    first = next(rounds)
    assert sum(first.values()) == min(size, 6)
    spark.createDataFrame([], cleanup.OUTCOMES).write.mode("overwrite").parquet(f"{folder}/round=1")  # begun and cut off
    tallies = [first, *cleanup.delete_unused(one, folder, may, 60, size)]
    assert {k: sum(t[k] for t in tallies) for k in first} == {"deleted": 4, "skipped": 2, "failed": 0}
    left = cleanup.after(one, folder)
    assert sorted(r.id for r in left.attachments.collect()) == [4, 5, 6, 8, 9]
    assert sorted((r.attachment_id, r.status) for r in left.results.collect()) == [(5, "used"), (6, "used"), (9, "used")]
    assert cleanup.delete_round(one, folder, may, 60, size) is None


def test_state():
    s = state.started(10, 5)
    s = state.advanced(s, 40, 7, 6)
    s = state.advanced(s, 90, 7, 7)
    assert (s.cursor, s.done, s.total, s.started_at, state.total_shown(s)) == (90, 14, 10, 5, 14)
    assert state.advanced(None, 3, 1, 9) == state.State(3, 1, 0, 9)
    assert state.finished(s, 2, 8) == (None, state.LastScan(8, 14, 2))
    assert [state.progress(*x) for x in ((0, 0), (1, 8), (1, 200), (5, 4))] == [0, 13, 1, 100]


def test_stored_state(site, tmp_path):
    """Start, advance, stop, resume, finish, reset: what another session reads is what was written last."""
    spark = site.posts.sparkSession
    store = state.Store(spark, f"{tmp_path}/log")
    assert store.current() is None and store.last_scan() is None
    store.reset()
    assert store.start(10, 5) == state.State(0, 0, 10, 5) and store.advance(40, 7, 6) == state.State(40, 7, 10, 5)
    again = state.Store(spark, f"{tmp_path}/log")
    assert again.current() == state.State(40, 7, 10, 5) and again.advance(90, 7, 7).done == 14
    assert store.finish(2, 8) == state.LastScan(8, 14, 2) and again.current() is None and again.last_scan() == state.LastScan(8, 14, 2)
    store.advance(3, 1, 9)
    assert again.current() == state.State(3, 1, 0, 9)  # a missing state is started first
    store.reset()
    assert again.current() is None and again.last_scan() == state.LastScan(8, 14, 2)


def test_scan_in_stored_batches(site, tmp_path):
    spark, results_at = site.posts.sparkSession, f"{tmp_path}/results"
    store = state.Store(spark, f"{tmp_path}/log")
    first = scan_batch(site, store, results_at, 50, size=3)
    assert (first.cursor, first.done, first.total) == (6, 3, 4)
    shown = listing.scan_card(site, state.current_of(store.log()), state.last_of(store.log()), spark.createDataFrame([(9,)], "changed_at long"), 100).first()
    assert shown.button == "Resume scan (3 / 4)" and shown.note is None
    assert scan_batch(site, state.Store(spark, f"{tmp_path}/log"), results_at, 60, size=3).done == 4
    assert scan_batch(site, store, results_at, 70, size=3) == state.LastScan(70, 4, 1)
    got = {r.attachment_id: (r.status, r.scanned_at) for r in merged(site, results_at).collect()}
    assert got == {4: ("used", 50), 5: ("unused", 50), 6: ("unused", 50), 123: ("used", 60), 99: ("used", 7)}
    shown = listing.scan_card(site, state.current_of(store.log()), state.last_of(store.log()), spark.createDataFrame([(99,)], "changed_at long"), 70 + 7200).first()
    assert (shown.button, shown.note) == ("Start full scan", "Last full scan finished 2 hours ago (4 files). Content has changed since — results may be stale.")


def test_checks(site):
    ids = site.posts.sparkSession.createDataFrame([(0,), (4,), (6,), (7,)], "attachment_id long")
    got = {r.attachment_id: r for r in listing.checked(site, ids, scanned(site, 60, ids=ids)).collect()}
    assert [got[i].outcome for i in (0, 4, 6, 7)] == ["refused", "checked", "checked", "refused"] and got[0].evidence is None
    assert (got[6].status, got[6].badge, got[6].evidence) == ("unused", "Unused", "No references found anywhere.")
    assert got[4].badge.startswith("Used (") and "Gallery — #23" in got[4].evidence.split("\n")


def test_a_few_ids(site):
    """The plan of a few ids gives what the whole scan gives; beyond the limit there are no literals."""
    spark = site.posts.sparkSession
    for ids in ([123], [4, 5, 6, 123], [7], []):
        few = spark.createDataFrame([(i,) for i in ids], "attachment_id long")
        assert sorted(map(tuple, scanned_few(site, few, 50).collect())) == sorted(map(tuple, scanned(site, 50, ids=few).collect()))
    assert needles_of(contexts(site.attachments), 3) is None and "hero.jpg" in needles_of(contexts(site.attachments), 4)


def test_shown_sizes_and_times(spark):
    sizes = {0: "0 B", 1: "1 B", 1000: "1,000 B", 1024: "1 KB", 2560: "3 KB", 1536: "2 KB", 1023 * 1024: "1,023 KB", 1 << 20: "1 MB", 5 << 30: "5 GB", 3 << 40: "3 TB"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", labels.size_text(F.col("n"))).collect()}
    assert got == sizes
    times = {0: "1 second", 59: "59 seconds", 60: "1 minute", 89: "1 minute", 90: "2 minutes", 3_600: "1 hour", 5_400: "2 hours", 86_400: "1 day", 604_800: "1 week", 2_592_000: "1 month", 31_536_000: "1 year", 63_072_000: "2 years"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in times], "n long").select("n", labels.time_difference(F.lit(5), F.col("n") + 5)).collect()}
    assert got == times
    assert spark.range(1).select(labels.ago(F.lit(0), F.lit(9))).first()[0] == "—"


def test_batches_match_a_loop(site):
    got = sorted(tuple(r) for r in state.batches(site, 3).collect())
    assert got == [(0, 6, 3), (1, 123, 4)]
    s, seen = state.State(), []
    while ids := [r[0] for r in state.next_batch(site, s, 3).collect()]:
        s = state.advanced(s, ids[-1], len(ids), 0)
        seen.append((s.cursor, s.done))
    assert seen == [(c, d) for _, c, d in got]


def test_streams(site, tmp_path):
    spark = site.posts.sparkSession
    rows = [(1, "post", 100), (2, "revision", 900), (3, "attachment", 800), (4, "page", 300)]
    changes = spark.createDataFrame(rows, "post_id long, post_type string, s long").select("post_id", "post_type", F.timestamp_seconds("s").alias("ts"))
    changes.write.parquet(f"{tmp_path}/changes")
    stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/changes")
    marker = staleness.Marker(spark, f"{tmp_path}/marker")
    assert marker.read().first() == (None,)
    staleness.follow(stream, marker, f"{tmp_path}/c1").awaitTermination(120)
    assert marker.read().first() == staleness.last_change(changes).first() == (300,)
    for n, ids in enumerate(([123, 4], [5])):
        spark.createDataFrame([(i,) for i in ids], "attachment_id long").write.parquet(f"{tmp_path}/ids/{n}")
        arriving = spark.readStream.schema("attachment_id long").option("recursiveFileLookup", True).parquet(f"{tmp_path}/ids")
        batches.scan_stream(site, arriving, f"{tmp_path}/results", f"{tmp_path}/c2", 50).awaitTermination(240)
    got = {r.attachment_id: r.status for r in spark.read.parquet(f"{tmp_path}/results").collect()}
    assert got == {123: "used", 4: "used", 5: "unused"}


def test_names_of_all_kinds(spark):
    """Short names, no extension, odd characters: the join finds what a plain search finds."""
    names = ["hero.jpg", "a.b", "x", "no-extension", "l.o.n.g.name.tar", "ünï.jpg", "p😀q.png", "a+b (1).gif", "b.png"]
    texts = ["superhero.jpg", "a.b", "xx", "a no-extension", "l.o.n.g.name.tar.gz", "zünï.jpgs", "p😀q.png", "a+b (1).gif", "", "b.pn", "jpg", "bb.png c.jpg"]
    ctx = spark.createDataFrame([(i, str(i), 0, [n]) for i, n in enumerate(names)], "attachment_id long, id_text string, parent_id long, basenames array<string>")
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, v string")
    got = {(r.k, r.attachment_id) for r in name_pairs(rows, "k", "v", ctx).collect()}
    assert got == {(k, i) for k, t in enumerate(texts) for i, n in enumerate(names) if n in t}


@pytest.mark.parametrize("marker", ["-150x150", "-scaled", ""])
def test_thumbnails_of_many_attachments(spark, marker):
    """Names that share their last characters: what is joined by name is what matches, not texts times attachments."""
    n = 400
    ctx = spark.createDataFrame([(i, str(i), 0, [f"photo-of-item-{i}{marker}.jpg", f"{i}-product.png"]) for i in range(n)], "attachment_id long, id_text string, parent_id long, basenames array<string>")
    texts = [(i, f"see /u/photo-of-item-{i}{marker}.jpg and other-{i}{marker}.jpg, x{i}-product.png.jpg") for i in range(n)]
    rows = spark.createDataFrame(texts, "k long, v string")
    found = name_pairs(rows, "k", "v", ctx)
    got = {(r.k, r.attachment_id) for r in found.collect()}
    names = [(i, x) for i in range(n) for x in (f"photo-of-item-{i}{marker}.jpg", f"{i}-product.png")]
    assert got == {(k, i) for k, t in texts for i, x in names if x in t}
    # Rows between the two joins: dots of a text times lengths that names have, however many names there are.
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    most = max(int(m.replace(",", "")) for m in re.findall(r"number of output rows: ([\d,]+)", metrics(plan)))
    assert most <= 40 * n


def test_read(spark, site, tmp_path):
    for name in COLUMNS:
        getattr(site, name).write.parquet(f"{tmp_path}/{name}.parquet")
    again = read(spark, str(tmp_path))
    assert again.posts.count() == len(POSTS) and again.attachments.schema.simpleString() == site.attachments.schema.simpleString()
