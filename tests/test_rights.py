"""Capabilities of users and what they are allowed."""

from pyspark.sql import functions as F

from refscan.operators import rights

STORED = {
    1: 'a:1:{s:13:"administrator";b:1;}',
    2: 'a:2:{s:6:"author";b:1;s:12:"upload_files";b:0;}',
    3: 'a:2:{s:10:"subscriber";b:1;s:12:"upload_files";b:1;}',
    4: 'a:2:{s:6:"editor";b:0;s:14:"manage_options";b:1;}',
    5: "administrator",
    6: None,
    7: 's:13:"administrator";b:1;',
    8: 'a:2:{s:6:"author";b:1;s:14:"manage_options";b:1;}',
    9: "a:0:{}",
}


def granted(spark):
    rows = spark.createDataFrame(list(STORED.items()), "user_id long, stored string")
    return rows.select("user_id", rights.capabilities(F.col("stored")).alias("capabilities"))


def test_capabilities(spark):
    got = {r.user_id: r.capabilities for r in granted(spark).collect()}
    assert got[1] == sorted(rights.ROLES["administrator"])
    assert got[2] == ["delete_posts"]
    assert got[3] == ["upload_files"]
    assert got[4] == ["manage_options"]
    assert all(got[i] == [] for i in (5, 6, 7, 9))
    own = {"keeper": ("upload_files", "scan_all")}
    text = spark.range(1).select(rights.capabilities(F.lit('a:1:{s:6:"keeper";b:1;}'), own).alias("c")).first().c
    assert text == ["scan_all", "upload_files"]


def test_requests(spark):
    authors = spark.createDataFrame([(10, 8), (11, 1), (12, None)], "attachment_id long, author long")
    asked = [(u, a, i) for u in (*STORED, 99, None) for a in ("check", "scan", "delete", "other", None) for i in (10, 11, 12, 13, None)]
    requests = spark.createDataFrame([(n, *x) for n, x in enumerate(asked)], "n long, user_id long, action string, attachment_id long")
    got = {r.n: r.allowed for r in rights.allowed(requests, granted(spark), authors).collect()}
    may = {(1, "check"), (1, "scan"), (1, "delete"), (3, "check"), (4, "scan"), (8, "check"), (8, "scan")}
    assert got == {n: (u, a) in may or (u, a, i) == (8, "delete", 10) for n, (u, a, i) in enumerate(asked)}
    none = {r.n for r in rights.allowed(requests, granted(spark)).where("allowed AND action = 'delete'").collect()}
    assert none == {n for n, (u, a, _) in enumerate(asked) if (u, a) == (1, "delete")}
