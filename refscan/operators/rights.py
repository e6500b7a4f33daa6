"""Who may check, scan and delete: users' capabilities as their meta rows store them, and requests that are allowed by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.site import Site

# What each action needs, and the capabilities of the platform's roles that matter here.
NEEDED = {"check": "upload_files", "scan": "manage_options", "delete": "manage_options"}
ROLES = {
    "administrator": ("upload_files", "manage_options", "delete_posts", "delete_others_posts"),
    "editor": ("upload_files", "delete_posts", "delete_others_posts"),
    "author": ("upload_files", "delete_posts"),
    "contributor": ("delete_posts",),
    "subscriber": (),
}
KEY = "wp_capabilities"


def capabilities(stored: Column, roles: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Sorted capabilities of a stored array of roles and capabilities: those that are given, without those that are said not to be.

    Of a text that is no such array there are none."""
    of = F.create_map(*(x for role, caps in (ROLES if roles is None else roles).items() for x in (F.lit(role), F.array(*map(F.lit, caps)).cast("array<string>"))))
    names = lambda said: F.regexp_extract_all(stored, F.lit(f's:[0-9]+:"([^"]*)";b:{said};'), F.lit(1))
    given = F.flatten(F.transform(names(1), lambda x: F.coalesce(F.element_at(of, x), F.array(x))))
    none = F.array().cast("array<string>")
    return F.when(F.rlike(stored, F.lit(r"\Aa:[0-9]+:\{")), F.array_sort(F.array_except(given, names(0)))).otherwise(none)


def granted(site: Site, key: str = KEY, roles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """user_id, capabilities: of each user with a row of the key, by the first one."""
    rows = site.usermeta.where(F.col("meta_key") == key).groupBy("user_id").agg(F.min_by(F.coalesce("meta_value", F.lit("")), "meta_id").alias("stored"))
    return rows.select("user_id", capabilities(F.col("stored"), roles).alias("capabilities"))


def can(capability: str | Column) -> Column:
    return F.coalesce(F.array_contains("capabilities", capability), F.lit(False))


def allowed(requests: DataFrame, grants: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """``requests`` (user_id, action, attachment_id, and more) with ``allowed``.

    An action needs its capability, a deletion also the right to that attachment: one's own, or those of others. An action
    or user that isn't known is not allowed. ``authors``: attachment_id, author; without it every attachment is another's."""
    needed = F.create_map(*(F.lit(x) for pair in NEEDED.items() for x in pair))
    rows = requests.join(grants, "user_id", "left")
    if authors is not None:
        rows = rows.join(authors.groupBy("attachment_id").agg(F.min("author").alias("author")), "attachment_id", "left")
    own = can("delete_posts") & F.coalesce(F.col("author") == F.col("user_id"), F.lit(False)) if authors is not None else F.lit(False)
    may = can(F.element_at(needed, F.col("action"))) & ((F.col("action") != "delete") | can("delete_others_posts") | own)
    return rows.select(*requests.columns, F.coalesce(may, F.lit(False)).alias("allowed"))


def deletable(site: Site, grants: DataFrame, user_id: int, authors: DataFrame | None = None) -> DataFrame:
    """attachment_id of what a user may delete: what ``deletion.plan`` takes."""
    asked = site.attachments.select(F.col("id").alias("attachment_id"), F.lit(user_id).cast("long").alias("user_id"), F.lit("delete").alias("action"))
    return allowed(asked, F.broadcast(grants.where(F.col("user_id") == user_id)), authors).where("allowed").select("attachment_id")  # one row
