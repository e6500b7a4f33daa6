"""A site from raw tables: serialized metadata, first rows of keys, odd columns."""

import pytest
from pyspark.sql import functions as F

from refscan.functions.phpser import Unreadable, file_of, value_of
from refscan.operators.context import contexts
from refscan.operators.results import decoded
from refscan.plans.scan import scanned
from refscan.sources import raw


def test_values():
    assert value_of('a:2:{s:1:"k";a:1:{i:0;s:4:"é b";}i:7;O:3:"Obj":1:{s:1:"x";d:0.5;}}') == {"k": {0: "é b"}, 7: {"x": 0.5}}
    assert [value_of(x) for x in ("N;", "b:1;", "i:-3;", 's:0:"";', "a:0:{}")] == [None, True, -3, "", {}]
    for bad in ("", "a:1:{i:0;i:1;", "a:1:{i:0;i:1;}x", 's:3:"ab";', "a:1:{d:0;i:1;}", "q", "a:2:{i:0;i:1;}", "i:x;", "d:x;"):
        with pytest.raises(Unreadable):
            value_of(bad)
    deep = "a:1:{i:0;" * 50_000 + "i:1;" + "}" * 50_000
    value = value_of(deep)
    for _ in range(50_000):
        value = value[0]
    assert value == 1


def test_files():
    meta = 'a:4:{s:5:"width";i:3;s:5:"sizes";a:3:{s:1:"m";a:1:{s:4:"file";s:5:"m.jpg";}s:1:"e";a:1:{s:4:"file";s:0:"";}s:1:"x";s:3:"odd";}s:14:"original_image";s:5:"o.jpg";s:8:"filesize";s:2:"12";}'
    assert file_of(meta) == {"original_image": "o.jpg", "sizes": [("m", {"file": "m.jpg"})], "filesize": 12}
    assert file_of(None) is None and file_of("i:3;") is None and file_of("broken{") is None
    assert file_of('a:2:{s:5:"sizes";s:1:"x";s:8:"filesize";d:NAN;}') == {"original_image": None, "sizes": [], "filesize": None}


def test_shaped(spark):
    """Names of columns in any case, more columns, none of some; several rows of a key; results that can't be read."""
    posts = spark.createDataFrame([(3, "attachment", "inherit", 9, "T", "image/png"), (4, "attachment", "trash", 0, None, None), (9, "post", "publish", 0, "Nine", ""), (10, None, "publish", 0, "", "")], "id long, post_type string, post_status string, post_parent int, post_title string, post_mime_type string")
    posts = posts.withColumn("post_content", F.when(F.col("id") == 9, "see m.jpg").otherwise("")).withColumn("extra", F.lit(1))
    meta = [(1, 3, "_wp_attached_file", "2020/a-scaled.jpg"), (2, 3, "_wp_attached_file", "later.jpg"), (3, 3, "_wp_attachment_metadata", 'a:2:{s:5:"sizes";a:1:{s:1:"m";a:1:{s:4:"file";s:5:"m.jpg";}}s:8:"filesize";i:5;}'), (4, 4, "_wp_attached_file", None), (5, 4, "_wp_attachment_metadata", "broken"), (6, 3, "_refscan_status", "used"), (7, 3, "_refscan_refs", '{"count":2,"refs":[{"d":"content"}]}'), (8, 3, "_refscan_scanned_at", "70x"), (9, 4, "_refscan_status", "odd"), (10, 4, "_refscan_refs", "nonsense"), (11, 9, None, "3")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {"posts": posts, "postmeta": frame(meta, "META_ID int, post_id long, meta_key string, meta_value string"), "options": frame([], "option_id long, option_name string, option_value string"), "termmeta": frame([], "meta_id long, term_id long, meta_key string, meta_value string"), "usermeta": frame([], "umeta_id long, user_id long, meta_key string, meta_value string"), "terms": frame([(1, "x")], "term_id long, name string"), "users": frame([(1, "u")], "ID long, display_name string")}
    site = raw.shaped(tables)
    got = {r.attachment_id: (r.parent_id, r.basenames) for r in contexts(site.attachments).collect()}
    assert got == {3: (9, ["a-scaled.jpg", "m.jpg", "a.jpg"]), 4: (0, [])}
    assert {r.id: (r.filesize, r.attached_file) for r in site.attachments.collect()} == {3: (5, "2020/a-scaled.jpg"), 4: (None, "")}
    assert sorted(map(tuple, site.results.collect())) == [(3, "used", 2, '[{"d":"content"}]', 70), (4, "odd", 0, "[]", 0)]
    assert [r.detector for r in decoded(site.results).collect()] == ["content"]
    assert {r.attachment_id: r.status for r in scanned(site, 1).collect()} == {3: "used", 4: "unused"}
    assert sorted(r.id for r in site.posts.collect()) == [9, 10]
