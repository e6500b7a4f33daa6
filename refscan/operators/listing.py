"""Lists and pages over stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..sources.site import Site
from .context import basename
from .results import decoded, known_status, status_counts

PAGE = 50


def ids_after(attachments: DataFrame, cursor: int, n: int) -> DataFrame:
    """The next n attachments by id, trashed ones too."""
    return attachments.where(F.col("id") > cursor).select(F.col("id").alias("attachment_id")).orderBy("attachment_id").limit(max(1, n))


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``rank``, from 1, by a column: ranks within ranges of it, so no task sees all rows."""
    ranges = rows.repartitionByRange(column).withColumn("part", F.spark_partition_id())
    within = ranges.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(column)))
    before = within.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    return within.join(before.select("part", "base"), "part").withColumn("rank", F.col("rank") + F.col("base")).select(*rows.columns, "rank")


def unused(site: Site) -> DataFrame:
    """Attachments marked unused: attachment_id, post_status and the stored result."""
    marked = site.results.where(site.collation.among(F.col("status"), "unused"))
    return site.attachments.select(F.col("id").alias("attachment_id"), "post_status").join(marked, "attachment_id")


def unused_ids(site: Site, n: int | None) -> DataFrame:
    """The first n unused attachments that aren't trashed, or all of them, in no order."""
    found = unused(site).where(~site.collation.among(F.col("post_status"), "trash")).select("attachment_id")
    return found if n is None else found.orderBy("attachment_id").limit(n)


def listed(site: Site) -> DataFrame:
    return unused(site).where(site.collation.among(F.col("post_status"), "inherit", "private"))


def unused_page(site: Site, page: int, size: int = PAGE) -> DataFrame:
    return listed(site).select("attachment_id", "scanned_at").orderBy("attachment_id").offset((max(1, page) - 1) * size).limit(size)


def file_sizes(site: Site) -> DataFrame:
    """attachment_id, bytes: the file's size, else the metadata's, else 0."""
    sizes = site.attachments.select(F.col("id").alias("attachment_id"), "filesize").join(site.files, "attachment_id", "left")
    return sizes.select("attachment_id", F.coalesce("size", "filesize", F.lit(0)).alias("bytes"))


def unused_table(site: Site, page: int, now: int, size: int = PAGE) -> DataFrame:
    """One page of unused attachments with what is shown of each: dashes for no date, no bytes and no scan."""
    shown = site.attachments.select(F.col("id").alias("attachment_id"), "title", "mime", "created", F.coalesce(basename(F.col("attached_file")), F.lit("")).alias("file"))
    rows = unused_page(site, page, size).join(shown, "attachment_id").join(file_sizes(site), "attachment_id")
    date = F.coalesce(F.date_format("created", "MMMM d, yyyy"), F.lit("—"))
    size_shown = F.when(F.col("bytes") > 0, labels.size_text(F.col("bytes"))).otherwise("—")
    return rows.select("attachment_id", labels.title_of(F.col("title"), F.col("file"), F.col("attachment_id")).alias("title"), "file", "mime", date.alias("date"), size_shown.alias("size"), labels.ago(F.col("scanned_at"), F.lit(now)).alias("scanned"))


def filtered(site: Site, wanted: str) -> DataFrame:
    """Attachments by stored status; unscanned are those without a result; any other word filters nothing."""
    ids = site.attachments.select(F.col("id").alias("attachment_id"))
    if wanted == "unscanned":
        return ids.join(site.results.select("attachment_id"), "attachment_id", "left_anti")
    if wanted in ("used", "unused"):
        return ids.join(site.results.where(F.col("status") == wanted).select("attachment_id"), "attachment_id", "left_semi")
    return ids


def usage_column(site: Site) -> DataFrame:
    """attachment_id, status, shown (count, 0 unless used), badge for every attachment."""
    rows = site.attachments.select(F.col("id").alias("attachment_id")).join(site.results, "attachment_id", "left")
    status = known_status(F.col("status"))
    shown = F.when(status == "used", F.col("ref_count")).otherwise(0)
    return rows.select("attachment_id", status.alias("status"), shown.alias("shown"), labels.badge(status, shown).alias("badge"))


def evidence(site: Site, refs: DataFrame, *more: str) -> DataFrame:
    """attachment_id, evidence (and ``more`` columns): the line shown for each reference; names are looked up when it is shown, never stored."""
    posts = site.posts.select(F.lit("post").alias("object_type"), F.col("id").alias("object_id"), F.col("title").alias("_title"))
    own = site.attachments.select(F.lit("post").alias("object_type"), F.col("id").alias("object_id"), F.col("title").alias("_title"))
    terms = site.terms.select(F.lit("term").alias("object_type"), F.col("term_id").alias("object_id"), F.col("name").alias("_term"))
    users = site.users.select(F.lit("user").alias("object_type"), F.col("user_id").alias("object_id"), F.col("display_name").alias("_user"))
    rows = refs.join(posts.unionByName(own), ["object_type", "object_id"], "left").join(terms, ["object_type", "object_id"], "left").join(users, ["object_type", "object_id"], "left")
    where = labels.where_text(*map(F.col, ("object_type", "object_id", "detail", "_title", "_term", "_user")))
    return rows.select("attachment_id", *more, labels.evidence(F.col("match"), where, F.col("object_type"), F.col("detail"), F.col("confidence")).alias("evidence"))


def checked(site: Site, ids: DataFrame, verdicts: DataFrame) -> DataFrame:
    """attachment_id, outcome, status, badge, evidence for each row of ``ids``; 0 and what is no attachment is refused.

    ``verdicts``: of a new scan of the ids. Evidence: a line for each reference kept, in order."""
    lines = evidence(site, decoded(verdicts), "place").groupBy("attachment_id").agg(F.array_sort(F.collect_list(F.struct("place", "evidence"))).alias("lines"))  # KEPT at most
    rows = ids.join(verdicts, "attachment_id", "left").join(lines, "attachment_id", "left")
    shown = F.when(F.col("status") == "used", F.col("ref_count")).otherwise(0)
    known = F.col("status").isNotNull()
    text = F.coalesce(F.array_join(F.transform("lines", lambda x: x["evidence"]), "\n"), F.lit("No references found anywhere."))
    return rows.select("attachment_id", F.when(known, "checked").otherwise("refused").alias("outcome"), "status", F.when(known, labels.badge(F.col("status"), shown)).alias("badge"), F.when(known, text).alias("evidence"))


def scan_card(site: Site, state: DataFrame, last: DataFrame, changed_at: DataFrame, now: int) -> DataFrame:
    """The counts, the last scan, whether content has changed since, and what the button says.

    ``state`` (cursor, done, total, started_at) and ``last`` (finished_at, scanned, unused): one row or none;
    ``changed_at``: one row (changed_at, epoch seconds)."""
    # The sentences that are shown.
    number = lambda c: F.format_number(c, 0)
    note = F.concat(F.lit("Last full scan finished "), labels.time_difference(F.col("finished_at"), F.lit(now)), F.lit(" ago ("), number("scanned"), F.lit(" files)."), F.when(F.col("changed_at") > F.col("finished_at"), " Content has changed since — results may be stale.").otherwise(""))
    button = F.when(F.col("done").isNull(), "Start full scan").otherwise(F.concat(F.lit("Resume scan ("), number("done"), F.lit(" / "), number("goal"), F.lit(")")))
    one = status_counts(site.attachments, site.results, site.collation).withColumn("one", F.lit(1))
    for more in (state.select("done", F.col("total").alias("goal")), last.select("finished_at", "scanned"), changed_at):  # tables of one row at most
        one = one.join(F.broadcast(more.withColumn("one", F.lit(1))), "one", "left")
    return one.select("used", "unused", "unscanned", "total", note.alias("note"), button.alias("button"))
