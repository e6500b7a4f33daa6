"""Candidate and verifying predicates: each takes the text and the attachment's id as text, and gives a boolean column.

Candidates are the broad pass, verifiers the precise one; neither implies the other, so a match needs both.
All are case-sensitive. They take whole texts: the scan decides the same forms for each occurrence (``operators.candidates``),
and is tested against these."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column, Column], Column]

# What surrounds an id in the gallery forms that are looked for in content.
GALLERY_FORMS = (('ids="', ""), (",", ","), (",", '"'), ("[", ","), (",", "]"), ("[", "]"))
#: What is trimmed off a plain value.
BLANKS = " \n\r\t\u000b\u0000"


def around(before: str, after: str) -> Predicate:
    return lambda v, i: F.contains(v, F.concat(F.lit(before), i, F.lit(after)))


def any_of(*predicates: Predicate) -> Predicate:
    return lambda v, i: reduce(lambda a, b: a | b, (p(v, i) for p in predicates))


def sized_string(v: Column, i: Column) -> Column:
    """A serialized string of exactly the id."""
    return F.contains(v, F.concat(F.lit("s:"), F.length(i).cast("string"), F.lit(':"'), i, F.lit('"')))


# The forms by which an id is looked up.
CANDIDATES: dict[str, Predicate] = {
    "exact": lambda v, i: v == i,
    "csv_start": lambda v, i: F.startswith(v, F.concat(i, F.lit(","))),
    "csv_end": lambda v, i: F.endswith(v, F.concat(F.lit(","), i)),
    "csv_mid": around(",", ","),
    "ser_int": around("i:", ";"),
    "ser_str": sized_string,
    "json_int": around('"id":', ""),
    "json_str": around('"id":"', '"'),
}
id_candidate = any_of(*CANDIDATES.values())
content_candidate = any_of(around("wp-image-", ""), around('"id":', ""), *(around(a, b) for a, b in GALLERY_FORMS))


def trimmed(v: Column) -> Column:
    return F.btrim(v, F.lit(BLANKS))


def matching(before: str, after: str) -> Predicate:
    """A regular expression with the id between two parts."""
    return lambda v, i: F.rlike(v, F.concat(F.lit(before), i, F.lit(after)))


# The forms that are accepted, as patterns in two halves around the id.
VERIFIERS: dict[str, Predicate] = {
    "exact": lambda v, i: trimmed(v) == i,
    "csv": lambda v, i: F.exists(F.split(v, ","), lambda x: trimmed(x) == i),
    "ser_int": around("i:", ";"),
    "ser_str": sized_string,
    "json_id": matching(r'"id":\s*"?', r"(?!\d)"),
    "wp_image": matching("wp-image-", r"(?!\d)"),
    "gallery_block": matching(r'"ids":\s*\[[^\]]*(?<!\d)', r"(?!\d)[^\]]*\]"),
    "gallery_sc": matching(r"""\[gallery[^\]]*ids=["'][^"']*(?<!\d)""", r"""(?!\d)[^"']*["']"""),
}


def has_basename(v: Column, basenames: Column) -> Column:
    """Whether any name occurs in the text, at whatever place."""
    return F.exists(basenames, lambda b: (b != "") & F.contains(v, b))


def in_structure(leaves: Column, i: Column, basenames: Column) -> Column:
    """Whether an int or string leaf is the id, or a string leaf holds a name."""
    return F.exists(leaves, lambda x: (x["value"] == i) | ((x["kind"] == "string") & has_basename(x["value"], basenames)))
