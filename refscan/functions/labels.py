"""Texts for display: labels of matches, badges, evidence lines, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label of each kind of match.
MATCH_LABELS = {
    "acf": "ACF field",
    "thumbnail": "Featured image",
    "woo-gallery": "Product gallery",
    "elementor": "Elementor content",
    "block-id": "Block attribute",
    "wp-image-class": "Image in content",
    "gallery": "Gallery",
    "url": "File URL",
    "widget": "Widget",
    "theme-mod": "Customizer setting",
    "site-option": "Site setting",
    "serialized": "Stored data",
    "comma-list": "ID list",
    "attached": "Uploaded to",
}
OTHER_LABEL = "ID value"
NOTES = {"confirmed": "", "info": " (record only — not a content reference)"}
POSSIBLE_NOTE = " (possible)"


def match_label(match: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in MATCH_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, match), F.lit(OTHER_LABEL))


def badge(status: Column, count: Column) -> Column:
    """The count shows only for used attachments that have any."""
    n = F.concat(F.lit("Used ("), count.cast("string"), F.when(count == 1, " reference)").otherwise(" references)"))
    return F.when(status == "used", F.when(count > 0, n).otherwise("Used")).when(status == "unused", "Unused").otherwise("Not scanned")


def where_text(object_type: Column, object_id: Column, detail: Column, title: Column, term: Column, user: Column) -> Column:
    """The object's name; its number if it has none."""
    number = object_id.cast("string")
    return (
        F.when(object_type == "post", F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("#"), number)))
        .when(object_type == "term", F.coalesce(term, F.concat(F.lit("term #"), number)))
        .when(object_type == "user", F.coalesce(user, F.concat(F.lit("user #"), number)))
        .when(object_type == "theme_mod", "Customizer")
        .otherwise(detail)
    )


def evidence(match: Column, where: Column, object_type: Column, detail: Column, confidence: Column) -> Column:
    shown = object_type.isin("post", "term", "user") & (detail != "") & (detail != match)
    note = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair)), confidence), F.lit(POSSIBLE_NOTE))
    return F.concat(match_label(match), F.lit(" — "), where, F.when(shown, F.concat(F.lit(" "), detail)).otherwise(""), note)


def title_of(title: Column, file: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(file, F.lit("")), F.concat(F.lit("#"), number.cast("string")))


def whole(x: Column) -> Column:
    """Rounded, halves up."""
    return F.floor(x + 0.5)


def size_text(size: Column) -> Column:
    """Bytes in the largest unit of which there is one at least, in whole units with a thousands mark."""
    out = F.lit("0 B")
    for n, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB", "EB")):
        scale = 1 << 10 * n
        out = F.when(size >= scale, F.concat(F.format_number(whole(size / scale), 0), F.lit(f" {unit}"))).otherwise(out)
    return out


# Units of a time difference and their seconds.
TIMES = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}


def time_difference(a: Column, b: Column) -> Column:
    """The time between two epoch seconds in the largest unit of which there is one at least, rounded; never 0 of it."""
    seconds = F.abs(a - b)
    out = None
    for unit, size in TIMES.items():
        n = F.greatest(F.lit(1), whole(seconds / size))
        text = F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
        out = text if out is None else F.when(seconds >= size, text).otherwise(out)
    return out


def ago(then: Column, now: Column) -> Column:
    """A dash for no time."""
    return F.when(then > 0, F.concat(time_difference(then, now), F.lit(" ago"))).otherwise("—")
