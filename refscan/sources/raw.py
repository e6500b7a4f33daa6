"""A site from the raw tables of its database: attachments are posts, and what is known of their files is serialized in meta rows.

Of a key with several rows the first one by meta_id counts, as it does for the site itself."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phpser import php_file
from .site import COLUMNS, OWN_PREFIX, Site

# The raw tables' columns that are read, and their types.
RAW = {
    "posts": {"ID": "long", "post_type": "string", "post_status": "string", "post_parent": "long", "post_title": "string", "post_mime_type": "string", "post_date": "timestamp", "post_modified": "timestamp", "post_content": "string"},
    "postmeta": {"meta_id": "long", "post_id": "long", "meta_key": "string", "meta_value": "string"},
    "options": {"option_id": "long", "option_name": "string", "option_value": "string"},
    "termmeta": {"meta_id": "long", "term_id": "long", "meta_key": "string", "meta_value": "string"},
    "usermeta": {"umeta_id": "long", "user_id": "long", "meta_key": "string", "meta_value": "string"},
    "terms": {"term_id": "long", "name": "string"},
    "users": {"ID": "long", "display_name": "string"},
}
#: Meta keys of an attachment's file and of its stored result, and the columns that they become.
FILE_KEYS = {"_wp_attached_file": "attached_file", "_wp_attachment_metadata": "metadata"}
RESULT_KEYS = {f"{OWN_PREFIX}status": "status", f"{OWN_PREFIX}refs": "refs", f"{OWN_PREFIX}scanned_at": "scanned_at"}


def typed(table: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The columns by their names, whatever their case; a column that is missing or has another type is null or cast."""
    own = {c.lower(): c for c in table.columns}
    return table.select(*((F.col(f"`{own[c.lower()]}`").try_cast(kind) if c.lower() in own else F.lit(None).cast(kind)).alias(c) for c, kind in columns.items()))


def by_key(meta: DataFrame, owner: str, keys: Mapping[str, str]) -> DataFrame:
    """One row for each owner: a column for each of the keys, with its first value. Only rows with these keys are grouped."""
    first = lambda key: F.min_by(F.coalesce("meta_value", F.lit("")), F.when(F.col("meta_key") == key, F.col("meta_id")))
    return meta.where(F.col("meta_key").isin(*keys)).groupBy(owner).agg(*(first(key).alias(name) for key, name in keys.items()))


def attachments_of(posts: DataFrame, postmeta: DataFrame) -> DataFrame:
    """The site's attachments: posts of that type, with their files' names and sizes out of the metadata, where that can be read."""
    files = by_key(postmeta, "post_id", FILE_KEYS).withColumn("file", php_file(F.col("metadata")))
    rows = posts.where("post_type = 'attachment'").join(files.withColumnRenamed("post_id", "ID"), "ID", "left")
    return rows.select(
        F.col("ID").alias("id"), "post_status", "post_parent", F.col("post_title").alias("title"), F.col("post_mime_type").alias("mime"), "attached_file",
        F.col("file.original_image"), F.col("file.sizes"), F.col("file.filesize"), F.to_date("post_date").alias("created"),
    )


def digits(text: Column) -> Column:
    """The number that a text begins with, or 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([0-9]{1,18})", 1).try_cast("long"), F.lit(0))


def results_of(postmeta: DataFrame) -> DataFrame:
    """Stored results out of the meta rows of attachments: those with a status; references and counts that can't be read are none."""
    found = by_key(postmeta, "post_id", RESULT_KEYS).where("status IS NOT NULL")
    refs = F.coalesce(F.get_json_object("refs", "$.refs"), F.lit("[]"))
    return found.select(F.col("post_id").alias("attachment_id"), "status", digits(F.get_json_object("refs", "$.count")).alias("ref_count"), refs.alias("refs_json"), digits(F.col("scanned_at")).alias("scanned_at"))


def shaped(tables: Mapping[str, DataFrame], files: DataFrame | None = None, scan_log: DataFrame | None = None) -> Site:
    """A site of raw tables (as ``site.of_jdbc`` reads them). files: sizes of local files; scan_log: the log of scans, if any.

    Content changes when posts are modified: without a log of changes, their times of modification stand for it."""
    raw = {name: typed(tables[name], columns) for name, columns in RAW.items()}
    posts, meta = raw["posts"], raw["postmeta"]
    empty = lambda name: posts.sparkSession.createDataFrame([], COLUMNS[name])
    return Site(
        attachments=attachments_of(posts, meta),
        posts=posts.where("post_type IS NULL OR post_type <> 'attachment'").select(F.col("ID").alias("id"), "post_type", "post_status", F.col("post_title").alias("title"), "post_content"),
        postmeta=meta,
        options=raw["options"],
        termmeta=raw["termmeta"],
        usermeta=raw["usermeta"].withColumnRenamed("umeta_id", "meta_id"),
        terms=raw["terms"],
        users=raw["users"].withColumnRenamed("ID", "user_id"),
        files=empty("files") if files is None else files,
        results=results_of(meta),
        changes=posts.select(F.col("ID").alias("post_id"), "post_type", F.col("post_modified").alias("ts")),
        scan_log=empty("scan_log") if scan_log is None else scan_log,
    )
