"""What is known of an attachment: its id, its parent and the names its files can be mentioned by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what is stripped off a name to get its stem's name: one marker of a derived file before the extension.
DERIVED = r"(?i)-(?:scaled|rotated|\d+x\d+)(\.[a-z0-9]+)$"


def basename(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)


def stem_name(name: Column) -> Column:
    return F.regexp_replace(name, DERIVED, "$1")


def basenames(attachments: DataFrame) -> Column:
    """Distinct names in the order attached file, original, sizes, stem; empty names and '0' don't count."""
    one = lambda c: F.array(F.coalesce(basename(F.col(c)), F.lit("")))
    sizes = F.coalesce(F.transform(F.map_values("sizes"), lambda s: F.coalesce(basename(s["file"]), F.lit(""))), F.array().cast("array<string>"))
    stem = F.array(stem_name(F.coalesce(basename(F.col("attached_file")), F.lit(""))))
    return F.array_distinct(F.filter(F.concat(one("attached_file"), one("original_image"), sizes, stem), lambda n: ~n.isin("", "0")))


def contexts(attachments: DataFrame) -> DataFrame:
    """attachment_id, id_text, parent_id, basenames: one row for each attachment, trashed ones too."""
    return attachments.select(F.col("id").alias("attachment_id"), F.col("id").cast("string").alias("id_text"), F.coalesce("post_parent", F.lit(0)).alias("parent_id"), basenames(attachments).alias("basenames"))
