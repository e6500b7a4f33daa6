"""Detectors: from a site and attachment contexts to references.

A detector of texts says which rows it reads and how a row's forms of an attachment (see ``candidates``) are graded, by an
ordered list of cases; a match needs a form that is looked up and one that is accepted. Any number of them run as one: their
rows' entries are one table, joined once with what is known of all attachments. A reference is
(attachment_id, detector, object_type, object_id, detail, match, confidence)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phpser import php_leaves
from ..sources import site as tables
from ..sources.site import Site
from . import candidates
from .candidates import BIT, CONTENT, FOUND_META, META, has

Detector = Callable[[Site, DataFrame], DataFrame]
REFS = ["attachment_id", "detector", "object_type", "object_id", "detail", "match", "confidence"]
#: Of a row of a text table: the detector's place, the row's id, the object it belongs to, its key, and what grading has to know besides.
ROW = ["ord", "row", "object_id", "detail", "state"]


def cases(*found: tuple[Column, str | None]) -> Column:
    """The value of the first condition that holds."""
    first, *rest = found
    out = F.when(first[0], F.lit(first[1]).cast("string"))
    for condition, value in rest:
        out = out.when(condition, F.lit(value).cast("string"))
    return out


@dataclass(frozen=True)
class TextDetector:
    """rows: of a site, as row, object_id, detail, state, text, and leaves if it has any; forms: of ids that are told apart;
    graded: match, or none, and confidence, by the columns of ROW, ``bits`` and ``field``; own: whether an object can mention itself;
    meta: the table, and the column of its objects, in which another key says that a key is a custom field; by_match: a reference's detail is how
    it matches, not its row's."""

    name: str
    object_type: str
    rows: Callable[[Site], DataFrame]
    forms: Sequence[str]
    graded: Callable[[], tuple[Column, Column]]
    own: bool = True
    meta: tuple[str, str] | None = None
    by_match: bool = False

    def __call__(self, site: Site, contexts: DataFrame) -> DataFrame:
        return found_together(site, contexts, {0: self}).select(*REFS)


def found_together(site: Site, contexts: DataFrame, chosen: dict[int, TextDetector], needles: Sequence[str] | None = None) -> DataFrame:
    """References of several detectors, with each one's place ``ord``: one pass over their tables, one join with ids and names.

    needles: if given, only texts that hold one of them are looked at; they must be all ids and names of the contexts."""
    about = candidates.known(contexts)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.rows(site).withColumn("ord", F.lit(n)) for n, d in chosen.items()))
    if needles is not None:
        rows = rows.where(reduce(lambda a, b: a | b, (F.contains("text", F.lit(x)) for x in needles), F.lit(False)))
    by_forms: dict[Sequence[str], list[int]] = {}
    for n, d in chosen.items():
        by_forms.setdefault(d.forms, []).append(n)
    ids = "CASE " + " ".join(f"WHEN ord IN ({', '.join(map(str, ords))}) THEN {candidates.numbers('text', forms, padded=site.collation.pad_space)}" for forms, ords in by_forms.items()) + " END"
    texts = f"array({candidates.a_text('text', 'name')})"
    if "leaves" in rows.columns:
        ids = f"concat({ids}, IF(leaves IS NOT NULL, {LEAF_IDS}, {candidates.NONE}))"
        texts = f"IF(leaves IS NOT NULL, array_append({texts}, {LEAF_TEXT}), {texts})"
    met = candidates.matched(candidates.entries(rows, ROW, ids, texts, about), ROW, about)
    alone = [n for n, d in chosen.items() if not d.own]
    met = met.where(~(F.col("ord").isin(alone) & F.col("object_id").eqNullSafe(F.col("attachment_id")))) if alone else met
    with_fields = {n: d.meta for n, d in chosen.items() if d.meta}
    met = with_field(met, site, with_fields) if with_fields else met.withColumn("field", F.lit(False))
    own = lambda of: reduce(lambda out, x: (F if out is None else out).when(F.col("ord") == x[0], of(x[1])), chosen.items(), None)
    # By a generator, which filters of later steps don't pass: they would repeat the whole grading until no code can be made of it.
    matches = F.filter(F.array_repeat(own(lambda d: d.graded()[0]), F.col("copies")), lambda x: x != "")
    graded = met.select("*", F.explode(matches).alias("match")).withColumn("confidence", own(lambda d: d.graded()[1]))
    kind = F.when(F.col("match") == "theme-mod", "theme_mod").otherwise(own(lambda d: d.object_type))
    detail = own(lambda d: F.col("match") if d.by_match else F.coalesce("detail", F.lit("")))
    return graded.select("attachment_id", own(lambda d: d.name).alias("detector"), kind.alias("object_type"), F.coalesce("object_id", F.lit(0)).alias("object_id"), detail.alias("detail"), "match", "confidence", "ord")


def fields(meta: DataFrame, owner: str) -> DataFrame:
    """_owner, _key, _field: for each object's key that begins with an underscore, whether its first value names a custom field."""
    return meta.where(F.col("meta_key").startswith("_")).groupBy(F.col(owner).alias("_owner"), F.col("meta_key").alias("_key")).agg(F.min_by(F.coalesce(F.col("meta_value").startswith("field_"), F.lit(False)), "meta_id").alias("_field"))


def with_sibling(rows: DataFrame, meta: DataFrame, owner: str) -> DataFrame:
    """Adds ``field``: whether the first value of the same owner's _key names a custom field."""
    joined = rows.join(fields(meta, owner), (F.col(owner) == F.col("_owner")) & (F.concat(F.lit("_"), F.col("meta_key")) == F.col("_key")), "left")
    field = ~F.col("meta_key").startswith("_") & F.col("_field")
    return joined.withColumn("field", F.coalesce(field, F.lit(False))).drop("_owner", "_key", "_field")


def with_field(met: DataFrame, site: Site, tables_of: dict[int, tuple[str, str]]) -> DataFrame:
    """Adds ``field`` to pairs of several tables."""
    every = reduce(DataFrame.unionByName, (fields(getattr(site, table), owner).where("_field").withColumn("_ord", F.lit(n)) for n, (table, owner) in tables_of.items()))
    joined = met.join(every, (F.col("ord") == F.col("_ord")) & (F.col("object_id") == F.col("_owner")) & (F.concat(F.lit("_"), F.col("detail")) == F.col("_key")), "left")
    return joined.withColumn("field", F.coalesce(~F.col("detail").startswith("_") & F.col("_field"), F.lit(False))).drop("_ord", "_owner", "_key", "_field")


def is_(*forms: str) -> Column:
    return has(F.col("bits"), *forms)


def plain_match() -> Column:
    """How a value holds a bare id, if it does."""
    return cases((is_("exact"), "exact"), (is_("csv"), "comma-list"), (is_("ser_str", "ser_int"), "serialized"), (is_("json_id"), "block-id"))


def looked_up(match: Column, *forms: str) -> Column:
    return F.when(is_(*forms, "name"), match)


def graded_content() -> tuple[Column, Column]:
    match = cases((is_("name"), "url"), (is_("wp_image"), "wp-image-class"), (is_("json_id"), "block-id"), (is_("gallery_block", "gallery_sc"), "gallery"))
    return looked_up(match, "find_content"), F.when(F.col("state") == "trash", "possible").otherwise("confirmed")


def graded_meta() -> tuple[Column, Column]:
    """Term and user meta: names are confirmed, bare ids possible unless the key is a custom field."""
    plain = plain_match()
    match = F.when(is_("name"), "url").when(plain.isNotNull() & F.col("field"), "acf").otherwise(plain)
    return looked_up(match, *FOUND_META), F.when(F.col("match").isin("url", "acf"), "confirmed").otherwise("possible")


def graded_postmeta() -> tuple[Column, Column]:
    key, url, plain = F.col("detail"), is_("name"), plain_match()
    special = cases(
        ((key == "_thumbnail_id") & is_("exact"), "thumbnail"),
        ((key == "_product_image_gallery") & is_("csv"), "woo-gallery"),
        ((key == "_elementor_data") & (is_("json_id") | url), "elementor"),
        (key == "_elementor_data", ""),  # closed: nothing else is tried
        (url, "url"),
    )
    match = F.coalesce(special, F.when(plain.isNotNull() & F.col("field"), "acf").otherwise(plain))
    sure = F.col("match").isin("thumbnail", "woo-gallery", "elementor", "url", "acf") & (F.col("state") != "trash")
    return looked_up(match, *FOUND_META), F.when(sure, "confirmed").otherwise("possible")


def graded_options() -> tuple[Column, Column]:
    name, inside = F.col("detail"), is_("leaf", "leaf_name")
    match = cases(
        (name.isin("site_icon", "site_logo") & is_("exact"), "site-option"),
        (name.startswith("theme_mods_") & inside, "theme-mod"),
        (name.startswith("theme_mods_"), ""),
        (name.startswith("widget_") & (inside | is_("ser_int")), "widget"),
        (name.startswith("widget_"), ""),
        (is_("name"), "url"),
        ((F.col("state") == "container") & inside, "serialized"),
        (F.col("state") == "container", ""),
        (is_("exact", "json_id"), "exact"),
    )
    sure = F.col("match").isin("site-option", "theme-mod", "url") | (F.col("match") == "widget") & inside
    return looked_up(match, *FOUND_META), F.when(sure, "confirmed").otherwise("possible")


def option_texts(site: Site) -> DataFrame:
    """Options with the leaves of their values; state: container, if the value is an array or object."""
    parsed = tables.option_rows(site).withColumn("php", php_leaves(F.col("option_value")))
    return parsed.select(F.col("option_id").alias("row"), F.lit(None).cast("long").alias("object_id"), F.col("option_name").alias("detail"), F.when(F.col("php.container"), "container").alias("state"), F.col("option_value").alias("text"), F.col("php.leaves").alias("leaves"))


#: Entries of leaves that are ids; the leaves that are strings, with what no name has between them.
LEAF_IDS = rf"transform(filter(leaves, x -> x.value RLIKE r'\A[0-9]+\z'), x -> concat('i{BIT['leaf']}:', x.value))"
LEAF_TEXT = candidates.a_text(r"array_join(transform(filter(leaves, x -> x.kind = 'string'), x -> x.value), '\0')", "leaf_name")


def meta_texts(rows: Callable[[Site], DataFrame], owner: str) -> Callable[[Site], DataFrame]:
    return lambda site: rows(site).select(F.col("meta_id").alias("row"), F.col(owner).alias("object_id"), F.col("meta_key").alias("detail"), F.lit(None).cast("string").alias("state"), F.col("meta_value").alias("text"))


def postmeta_texts(site: Site) -> DataFrame:
    return tables.postmeta_rows(site).select(F.col("meta_id").alias("row"), F.col("post_id").alias("object_id"), F.col("meta_key").alias("detail"), F.col("post_status").alias("state"), F.col("meta_value").alias("text"))


def content_texts(site: Site) -> DataFrame:
    return tables.content_rows(site).select(F.col("id").alias("row"), F.col("id").alias("object_id"), F.lit(None).cast("string").alias("detail"), F.col("post_status").alias("state"), F.col("post_content").alias("text"))


postmeta = TextDetector("postmeta", "post", postmeta_texts, META, graded_postmeta, own=False, meta=("postmeta", "post_id"))
post_content = TextDetector("content", "post", content_texts, CONTENT, graded_content, own=False, by_match=True)
options = TextDetector("options", "option", option_texts, META, graded_options)
termmeta = TextDetector("termmeta", "term", meta_texts(tables.termmeta_rows, "term_id"), META, graded_meta, meta=("termmeta", "term_id"))
usermeta = TextDetector("usermeta", "user", meta_texts(tables.usermeta_rows, "user_id"), META, graded_meta, meta=("usermeta", "user_id"))


def attached(site: Site, contexts: DataFrame) -> DataFrame:
    parents = site.owners.where("post_type <> 'revision'").select(F.col("id").alias("parent_id"))
    rows = contexts.where("parent_id > 0").join(parents, "parent_id")
    said = {"detector": "attached", "object_type": "post", "detail": "post_parent", "match": "attached", "confidence": "info"}
    return rows.withColumn("object_id", F.col("parent_id")).withColumns({k: F.lit(v) for k, v in said.items()}).select(*REFS)


#: In the order in which references are kept.
DETECTORS: dict[str, Detector] = {"postmeta": postmeta, "content": post_content, "options": options, "termmeta": termmeta, "usermeta": usermeta, "attached": attached}


def all_references(site: Site, contexts: DataFrame, detectors: dict[str, Detector] | None = None, needles: Sequence[str] | None = None) -> DataFrame:
    """References of all detectors (own ones may be added, replaced or left out), duplicates kept, with the detector's place ``ord``.

    needles: see ``found_together``; own detectors don't get them."""
    chosen = dict(enumerate((DETECTORS if detectors is None else detectors).values()))
    texts = {n: find for n, find in chosen.items() if isinstance(find, TextDetector)}
    found = [find(site, contexts).select(*REFS).withColumn("ord", F.lit(n)) for n, find in chosen.items() if n not in texts]
    return reduce(DataFrame.unionByName, [*([found_together(site, contexts, texts, needles)] if texts else []), *found])
