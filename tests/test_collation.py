"""Texts that differ by case or blanks at their end, under each collation."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from refscan.operators import candidates, detectors, listing
from refscan.operators.context import contexts
from refscan.plans.scan import scanned, scanned_few
from refscan.sources import fixtures
from refscan.sources.site import Collation, content_rows, option_rows, postmeta_rows, usermeta_rows
from tests.conftest import DATA

MODES = [Collation(case, pad) for case in (False, True) for pad in (False, True)]


@pytest.fixture(scope="module")
def plain(spark):
    return fixtures.site(spark, f"{DATA}/sf0.001")


@pytest.mark.parametrize("mode", MODES)
def test_what_is_read(spark, plain, mode):
    """What the database compares follows the collation; parts are looked for with the blanks that are there."""
    words = ["{}", "{} ", "{}\t", " {}"]
    keys = [w.format(x) for w in words for x in ("cron", "CRON", "_transient_x", "_TRANSIENT_x", "_edit_lock", "_Edit_Lock", "session_tokens", "x_capabilities", "X_CAPABILITIES", "_refscan_x", "_REFSCAN_x", "fine", "")]
    same = lambda a, b: (a.lower() if mode.ignore_case else a).rstrip(" " if mode.pad_space else "") == b
    low = lambda a: a.lower() if mode.ignore_case else a
    named = spark.createDataFrame([(i, k, "v") for i, k in enumerate(keys)], "option_id long, option_name string, option_value string")
    meta = spark.createDataFrame([(i, 1_000_001, k, "v") for i, k in enumerate(keys)], "meta_id long, post_id long, meta_key string, meta_value string")
    posts = spark.createDataFrame([(1_000_001, "post", "publish", "", "x")] + [(i, t, st, "", "x") for i, (t, st) in enumerate((t, st) for t in ("page", "Revision", "revision ", "REVISION  ") for st in ("publish", "auto-draft", "Auto-Draft", "auto-draft "))], "id long, post_type string, post_status string, title string, post_content string")
    site = replace(plain, options=named, postmeta=meta, posts=posts, usermeta=meta.withColumnRenamed("post_id", "user_id"), collation=mode)
    got = {r.option_id for r in option_rows(site).collect()}
    assert got == {i for i, k in enumerate(keys) if not same(k, "cron") and not low(k).startswith("_transient_")}
    got = {r.meta_id for r in postmeta_rows(site).collect()}
    assert got == {i for i, k in enumerate(keys) if not same(k, "_edit_lock") and not low(k).startswith("_refscan_")}
    got = {r.meta_id for r in usermeta_rows(site).collect()}
    assert got == {i for i, k in enumerate(keys) if not same(k, "session_tokens") and not low(k).endswith("capabilities")}
    got = {r.id for r in content_rows(site).collect()}
    assert got == {r.id for r in posts.collect() if not same(r.post_type, "revision") and not same(r.post_status, "auto-draft")}


@pytest.mark.parametrize("mode", MODES)
def test_ids_with_blanks_at_their_end(spark, plain, mode):
    values = ["123", "123 ", "123   ", " 123", "123\t", "123\n ", "123 ,", "x 123 ", "", " ", None]
    rows = spark.createDataFrame([(i, 1, f"key{i}", v) for i, v in enumerate(values)], "meta_id long, term_id long, meta_key string, meta_value string")
    one = plain.attachments.limit(1).withColumn("id", F.lit(123).cast("long"))
    site = replace(plain, attachments=one, termmeta=rows, collation=mode)
    got = {r.detail for r in detectors.termmeta(site, contexts(one)).collect()}
    want = {"key0", "key1", "key2"} if mode.pad_space else {"key0"}
    assert got == want
    if mode != MODES[-1]:
        return
    few = spark.createDataFrame([(123,)], "attachment_id long")
    only = replace(site, posts=site.posts.limit(0), postmeta=site.postmeta.limit(0), options=site.options.limit(0), usermeta=site.usermeta.limit(0))
    assert scanned_few(only, few, 1).first().ref_count == scanned(only, 1).first().ref_count == len(want)


def test_lists(spark, plain):
    """By bytes a status in capitals is neither trash nor a verdict; without case it is."""
    attachments = spark.createDataFrame([(1, "Trash"), (2, "inherit"), (3, "Private "), (4, "trash")], "id long, post_status string")
    stored = spark.createDataFrame([(i, "UNUSED " if i == 3 else "unused") for i in range(1, 5)], "attachment_id long, status string")
    ids = lambda df: [r.attachment_id for r in df.collect()]
    site = lambda *c: replace(plain, attachments=attachments, results=stored, collation=Collation(*c))
    assert ids(listing.unused_ids(site(), 9)) == [1, 2] and ids(listing.unused_ids(site(True), 9)) == [2] and ids(listing.unused_ids(site(True, True), 9)) == [2, 3]
    assert ids(listing.listed(site())) == [2] and sorted(ids(listing.listed(site(True, True)))) == [2, 3]


def test_filters_are_pushed_down_by_bytes(plain):
    """No collation of its own: the filters reach the files as before."""
    plan = option_rows(plain)._jdf.queryExecution().executedPlan().toString()
    assert "collate" not in plan.lower() and candidates.PADDED.keys() <= candidates.FORMS.keys()
