"""The tables of a site, as DataFrames.

``posts`` holds all content but attachments; attachments are rows of their own table with their file's
metadata. All ids are longs, all texts strings, ``sizes`` maps a size's name to its file.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {
    "attachments": "id long, post_status string, post_parent long, title string, mime string, attached_file string, original_image string, sizes map<string,struct<file:string>>, filesize long, created date",
    "posts": "id long, post_type string, post_status string, title string, post_content string",
    "postmeta": "meta_id long, post_id long, meta_key string, meta_value string",
    "options": "option_id long, option_name string, option_value string",
    "termmeta": "meta_id long, term_id long, meta_key string, meta_value string",
    "usermeta": "meta_id long, user_id long, meta_key string, meta_value string",
    "terms": "term_id long, name string",
    "users": "user_id long, display_name string",
    "files": "attachment_id long, size long",
    "results": "attachment_id long, status string, ref_count long, refs_json string, scanned_at long",
    "changes": "post_id long, post_type string, ts timestamp",
    "scan_log": "seq long, kind string, cursor long, done long, total long, started_at long, finished_at long, scanned long, unused long",
}


@dataclass(frozen=True)
class Collation:
    """How the site's database compares texts: whether letters of both cases are equal, and whether blanks at the end count.

    It decides what the database itself compares: which rows are read, and by which values they are looked up. How a value
    that was read is graded is decided by its bytes under any collation."""

    ignore_case: bool = False
    pad_space: bool = False

    def among(self, text: Column, *values: str) -> Column:
        """Whether a text equals one of the values."""
        name = ("UTF8_LCASE" if self.ignore_case else "UTF8_BINARY") + ("_RTRIM" if self.pad_space else "")
        return (text if name == "UTF8_BINARY" else F.collate(text, name)).isin(*values)

    def like(self, text: Column) -> Column:
        """A text to look for parts in: blanks at its end count under any collation."""
        return F.collate(text, "UTF8_LCASE") if self.ignore_case else text


#: By bytes.
BINARY = Collation()


@dataclass(frozen=True)
class Site:
    attachments: DataFrame
    posts: DataFrame
    postmeta: DataFrame
    options: DataFrame
    termmeta: DataFrame
    usermeta: DataFrame
    terms: DataFrame
    users: DataFrame
    files: DataFrame
    results: DataFrame
    changes: DataFrame
    scan_log: DataFrame
    collation: Collation = BINARY

    @cached_property
    def owners(self) -> DataFrame:
        """id, post_type, post_status of posts and attachments: what a meta row or a parent can refer to."""
        own = self.attachments.select("id", F.lit("attachment").alias("post_type"), "post_status")
        return self.posts.select("id", "post_type", "post_status").unionByName(own)


def read(spark: SparkSession, folder: str, **formats: str) -> Site:
    """A site from parquet files of the tables' names (or the formats given), with the schemas above."""
    return Site(**{name: spark.read.format(formats.get(name, "parquet")).schema(schema).load(f"{folder}/{name}.{formats.get(name, 'parquet')}") for name, schema in COLUMNS.items()})


def of_jdbc(spark: SparkSession, url: str, prefix: str, partition: tuple[str, int, int, int] | None = None) -> dict[str, DataFrame]:
    """A live site's raw tables by JDBC, split by a numeric column (name, lowest, highest, parts) where given; shape them to ``COLUMNS``."""
    options = {} if partition is None else dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition), strict=True))
    return {t: spark.read.format("jdbc").options(url=url, dbtable=f"{prefix}{t}", **options).load() for t in ("posts", "postmeta", "options", "termmeta", "usermeta", "terms", "users")}


def content_rows(site: Site) -> DataFrame:
    """id, post_status, post_content of posts that content can be found in."""
    among = site.collation.among
    kept = ~among(F.col("post_type"), "attachment", "revision", "nav_menu_item") & ~among(F.col("post_status"), "auto-draft")
    return site.posts.where(kept).select("id", "post_status", F.coalesce("post_content", F.lit("")).alias("post_content"))


# Meta keys and options that never hold references.
SKIPPED_KEYS = ("_wp_attached_file", "_wp_attachment_metadata", "_wp_attachment_image_alt", "_wp_old_slug", "_wp_old_date", "_edit_lock", "_edit_last")
SKIPPED_OPTIONS = ("cron", "refscan_scan_state", "refscan_last_scan", "refscan_changed_at", "rewrite_rules", "wp_user_roles", "active_plugins", "recently_edited", "uninstall_plugins")
OWN_PREFIX = "_refscan_"


def postmeta_rows(site: Site) -> DataFrame:
    """Meta rows with their owner's status; rows without an owner, of revisions, of own or skipped keys (or none) go."""
    key = F.col("meta_key")
    kept = ~site.collation.like(key).startswith(OWN_PREFIX) & ~site.collation.among(key, *SKIPPED_KEYS)
    owner = site.owners.where(~site.collation.among(F.col("post_type"), "revision")).select(F.col("id").alias("post_id"), "post_status")
    return site.postmeta.where(kept).join(owner, "post_id").select("meta_id", "post_id", "meta_key", F.coalesce("meta_value", F.lit("")).alias("meta_value"), "post_status")


def option_rows(site: Site) -> DataFrame:
    name = site.collation.like(F.col("option_name"))
    kept = ~name.startswith("_transient_") & ~name.startswith("_site_transient_") & ~site.collation.among(F.col("option_name"), *SKIPPED_OPTIONS)
    return site.options.where(kept).select("option_id", "option_name", F.coalesce("option_value", F.lit("")).alias("option_value"))


def termmeta_rows(site: Site) -> DataFrame:
    return site.termmeta.select("meta_id", "term_id", "meta_key", F.coalesce("meta_value", F.lit("")).alias("meta_value"))


def usermeta_rows(site: Site) -> DataFrame:
    key = site.collation.like(F.col("meta_key"))
    kept = ~site.collation.among(F.col("meta_key"), "session_tokens") & ~key.endswith("capabilities") & ~key.endswith("user_level") & ~key.contains("user-settings")
    return site.usermeta.where(kept).select("meta_id", "user_id", "meta_key", F.coalesce("meta_value", F.lit("")).alias("meta_value"))
