"""Registered queries over the derived site, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.predicates import CANDIDATES
from ..operators import candidates, context, deletion, detectors, listing, results, rights, state
from ..operators.lineage import shared_dir
from ..operators.stored import Results
from ..sources import fixtures, raw, site as tables
from ..sources.fixtures import NOW
from ..sources.site import Collation, Site
from ..streaming.staleness import Marker, follow, is_stale, last_change
from . import cleanup
from . import oracles as o
from .scan import chosen, references, scanned, scanned_few

Query = Callable[[Site], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def ctx(s: Site) -> DataFrame:
    return context.contexts(s.attachments)


# Scans and filters
register("src_content", tables.content_rows, o.with_views("SELECT id, post_status, post_content FROM content", sources=("content",)))
register("src_postmeta", tables.postmeta_rows, o.with_views("SELECT meta_id, post_id, meta_key, meta_value, post_status FROM pm", sources=("pm",), owners=True))
register("src_options", tables.option_rows, o.with_views("SELECT option_id, option_name, option_value FROM op", sources=("op",)))
register("src_termmeta", tables.termmeta_rows, o.with_views("SELECT * FROM termmeta", "termmeta"))
register("src_usermeta", tables.usermeta_rows, o.with_views("SELECT * FROM um", sources=("um",)))
register("src_ids_after", lambda s: listing.ids_after(s.attachments, 40, 25), o.with_views("SELECT id AS attachment_id FROM attachments WHERE id > 40 ORDER BY id LIMIT 25"))
register("src_point", lambda s: s.results.join(s.attachments.select(F.col("id").alias("attachment_id"), "post_status"), "attachment_id").where("attachment_id = 7").select("attachment_id", "post_status", "status"), o.with_views("SELECT attachment_id, post_status, status FROM results JOIN attachments ON id = attachment_id WHERE attachment_id = 7", "results"))
register("src_file", listing.file_sizes, o.with_views("SELECT a.id AS attachment_id, coalesce(f.size, a.filesize, 0) AS bytes FROM attachments a LEFT JOIN files f ON f.attachment_id = a.id", "files"))
register("fil_postmeta", lambda s: tables.postmeta_rows(s).groupBy("meta_key").agg(F.count("*").alias("n")), o.with_views("SELECT meta_key, count(*) AS n FROM pm GROUP BY meta_key", sources=("pm",), owners=True))
register("fil_content", lambda s: s.posts.join(tables.content_rows(s).select("id"), "id", "left_anti").select("id", "post_type", "post_status"), o.with_views("SELECT id, post_type, post_status FROM posts WHERE id NOT IN (SELECT id FROM content)", sources=("content",)))
register("fil_options", lambda s: tables.option_rows(s).select(F.regexp_extract("option_name", "^[a-z_]+", 0).alias("stem")).groupBy("stem").agg(F.count("*").alias("n")), o.with_views("SELECT regexp_extract(option_name, '^[a-z_]+') AS stem, count(*) AS n FROM op GROUP BY 1", sources=("op",)))
register("fil_usermeta", lambda s: tables.usermeta_rows(s).groupBy("meta_key").agg(F.count("*").alias("n")), o.with_views("SELECT meta_key, count(*) AS n FROM um GROUP BY meta_key", sources=("um",)))

# The same under other collations, on a site whose texts differ by case and blanks at the end
COLLATIONS = {"bytes": tables.BINARY, "case": Collation(ignore_case=True), "pad": Collation(pad_space=True), "both": Collation(True, True)}


def by_collation(query: Query) -> Query:
    """A query's rows under each collation."""
    return lambda s: reduce(DataFrame.unionByName, (query(fixtures.unevened(s, c)).withColumn("collation", F.lit(name)) for name, c in COLLATIONS.items()))


def by_collation_sql(select: str, *views: str, **needs) -> str:
    return "\nUNION ALL\n".join(f"(SELECT *, '{c}' AS collation FROM ({o.with_views(select, *views, collation=c, **needs)}))" for c in COLLATIONS)


for name, rows, key, source in (("postmeta", tables.postmeta_rows, "meta_key", "pm"), ("options", tables.option_rows, "option_name", "op"), ("usermeta", tables.usermeta_rows, "meta_key", "um"), ("content", tables.content_rows, "post_status", "content")):
    register(f"fil_{name}_collated", by_collation(lambda s, rows=rows, key=key: rows(s).groupBy(key).agg(F.count("*").alias("n"))), by_collation_sql(f"SELECT {key}, count(*) AS n FROM {source} GROUP BY 1", sources=(source,), owners=source == "pm"))

# Contexts
register("ctx_basename", lambda s: s.attachments.select("id", context.basename(F.col("attached_file")).alias("base")), o.with_views("SELECT id, regexp_extract(attached_file, '[^/]*$') AS base FROM attachments"))
register("ctx_original", lambda s: s.attachments.select("id", context.basename(F.col("original_image")).alias("base")).where("base <> ''"), o.with_views("SELECT id, original_image AS base FROM attachments WHERE original_image <> ''"))
register("ctx_sizes", lambda s: s.attachments.select("id", F.explode(F.map_values("sizes")).alias("size")).select("id", context.basename(F.col("size.file")).alias("base")), o.with_views("SELECT id, size_thumb AS base FROM attachments"))
register("ctx_stem", lambda s: s.attachments.select("id", context.basename(F.col("attached_file")).alias("base")).select("id", context.stem_name(F.col("base")).alias("name")).where("name <> ''"), o.with_views("SELECT id, stem || '.jpg' AS name FROM attachments"))
register("ctx_names", lambda s: ctx(s).select("attachment_id", F.array_join("basenames", "|").alias("names")), o.with_views("SELECT attachment_id, array_to_string(basenames, '|') AS names FROM ctx", context=True))
register("ctx_parent", lambda s: ctx(s).select("attachment_id", "parent_id"), o.with_views("SELECT id AS attachment_id, coalesce(post_parent, 0) AS parent_id FROM attachments"))
register("ctx_build", lambda s: ctx(s).select("attachment_id", "id_text", "parent_id", F.size("basenames").cast("long").alias("n"), F.array_join("basenames", "|").alias("names")), o.with_views("SELECT attachment_id, i AS id_text, parent_id, len(basenames) AS n, array_to_string(basenames, '|') AS names FROM ctx", context=True))
register("set_distinct_names", lambda s: ctx(s).select("attachment_id", F.posexplode("basenames").alias("place", "name")).select("attachment_id", F.col("place").cast("long"), "name"), o.with_views("SELECT attachment_id, generate_subscripts(basenames, 1) - 1 AS place, unnest(basenames) AS name FROM ctx", context=True))


# The same site from raw tables, with serialized metadata
def from_raw(s: Site) -> Site:
    return raw.shaped(fixtures.raw(s), s.files)


ATTACHMENT = ("id", "post_status", "post_parent", "title", "mime", "attached_file", "original_image", "filesize", "created")
register("src_raw", lambda s: from_raw(s).attachments.select(*ATTACHMENT, F.element_at("sizes", F.lit("thumbnail"))["file"].alias("size_thumb")), o.with_views(f"SELECT {', '.join(ATTACHMENT)}, size_thumb FROM attachments"))
register("src_raw_results", lambda s: from_raw(s).results, o.with_views("SELECT attachment_id, status, ref_count, CASE WHEN starts_with(refs_json, '[') THEN refs_json ELSE '[]' END AS refs_json, scanned_at FROM results", "results"))
register("ctx_raw", lambda s: ctx(from_raw(s)).select("attachment_id", "id_text", "parent_id", F.size("basenames").cast("long").alias("n"), F.array_join("basenames", "|").alias("names")), SQL["ctx_build"])


# Candidates and verifiers, over all pairs of a table's rows and attachments
def by_form(rows: Callable[[Site], DataFrame], key: str, text: str, form: str, every_prefix: bool = False) -> Query:
    """Pairs of which an occurrence has the form, one for each row."""
    return lambda s: candidates.repeated(candidates.mentions(rows(s), key, text, ctx(s), [form], every_prefix=every_prefix).where(candidates.has(F.col("bits"), form))).select(F.col(key).alias("row_id"), "attachment_id")


meta = (tables.postmeta_rows, "meta_id", "meta_value")
posts = (tables.content_rows, "id", "post_content")
META_PAIRS = "SELECT meta_id AS row_id, attachment_id FROM (SELECT meta_id, meta_value AS v FROM pm) t JOIN ctx ON "
POST_PAIRS = "SELECT id AS row_id, attachment_id FROM (SELECT id, post_content AS v FROM content) t JOIN ctx ON "
for name in CANDIDATES:
    register(f"cand_{name}", by_form(*meta, name if name in candidates.FORMS else f"find_{name}", every_prefix=True), o.with_views(META_PAIRS + o.CAND[name], sources=("pm",), context=True, owners=True))
for name in ("exact", "csv", "ser_int", "ser_str", "json_id"):
    register(f"ver_{name}", by_form(*meta, name), o.with_views(META_PAIRS + o.VER[name], sources=("pm",), context=True, owners=True))
for name in ("wp_image", "gallery_block", "gallery_sc"):
    register(f"ver_{name}", by_form(*posts, name), o.with_views(POST_PAIRS + o.VER[name], sources=("content",), context=True))


def named(s: Site) -> DataFrame:
    return candidates.name_pairs(tables.content_rows(s), "id", "post_content", ctx(s)).select(F.col("id").alias("row_id"), "attachment_id")


def verified_names(s: Site) -> DataFrame:
    return candidates.name_pairs(tables.postmeta_rows(s), "meta_id", "meta_value", ctx(s)).select(F.col("meta_id").alias("row_id"), "attachment_id")


def structures(s: Site) -> DataFrame:
    about = candidates.known(ctx(s))
    found = candidates.entries(detectors.option_texts(s), ["row"], detectors.LEAF_IDS, f"array({detectors.LEAF_TEXT})", about)
    return candidates.repeated(candidates.matched(found, ["row"], about)).select(F.col("row").alias("row_id"), "attachment_id")


register("cand_content", by_form(*posts, "find_content", every_prefix=True), o.with_views(POST_PAIRS + o.CONTENT, sources=("content",), context=True))
register("cand_basename", named, o.with_views(POST_PAIRS + o.NAMED, sources=("content",), context=True))
register("ver_basename", verified_names, o.with_views(META_PAIRS + o.NAMED, sources=("pm",), context=True, owners=True))
register("ver_structure", structures, o.with_views(f"SELECT option_id AS row_id, attachment_id FROM (SELECT option_id, option_value AS v FROM op) t JOIN ctx ON {o.INSIDE}", sources=("op",), context=True))
register("join_theta_id", lambda s: candidates.id_pairs(tables.option_rows(s), "option_id", "option_value", ctx(s)), o.with_views("SELECT DISTINCT option_id, attachment_id FROM (SELECT option_id, unnest(regexp_extract_all(option_value, '[0-9]+')) AS i FROM op) t JOIN ctx USING (i)", sources=("op",), context=True))
register("join_theta_name", lambda s: candidates.name_pairs(tables.option_rows(s), "option_id", "option_value", ctx(s)), o.with_views(f"SELECT option_id, attachment_id FROM (SELECT option_id, option_value AS v FROM op) t JOIN ctx ON {o.NAMED}", sources=("op",), context=True))

# Detectors
for name, find in detectors.DETECTORS.items():
    views = {"termmeta": ("termmeta",), "usermeta": ("usermeta",)}.get(name, ())
    register(f"det_{name}", lambda s, find=find: find(s, ctx(s)), o.with_views(f"SELECT attachment_id, detector, object_type, object_id, detail, match, confidence FROM ({o.DETECT[name]})", *views, sources=o.USES[name], context=True, owners=name in ("postmeta", "attached")))

register(
    "det_postmeta_collated",
    lambda s: detectors.postmeta(u := fixtures.unevened(s, COLLATIONS["both"]), ctx(u)),
    o.with_views(f"SELECT attachment_id, detector, object_type, object_id, detail, match, confidence FROM ({o.DETECT['postmeta'].replace(o.ANY_ID, o.ANY_ID_PADDED)})", sources=("pm",), context=True, owners=True, collation="both"),
)

# Joins
register("join_pm_posts", lambda s: s.postmeta.join(s.owners.withColumnRenamed("id", "post_id"), "post_id").groupBy("post_type", "post_status").agg(F.count("*").alias("n")), o.with_views("SELECT post_type, o.post_status, count(*) AS n FROM postmeta m JOIN owners o ON m.post_id = o.id GROUP BY ALL", "postmeta", owners=True))
register("join_status", lambda s: listing.unused(s).groupBy("post_status").agg(F.count("*").alias("n")), o.with_views(f"SELECT post_status, count(*) AS n FROM ({o.UNUSED}) GROUP BY post_status", "results"))
register("join_unused_ids", lambda s: listing.unused_ids(s, 30), o.with_views(f"SELECT attachment_id FROM ({o.UNUSED}) WHERE post_status <> 'trash' ORDER BY attachment_id LIMIT 30", "results"))


def siblings(rows: Callable[[Site], DataFrame], owner: str) -> Query:
    return lambda s: detectors.with_sibling(rows(s), rows(s), owner).select("meta_id", "field")


for name, table, owner in (("post", "postmeta", "post_id"), ("term", "termmeta", "term_id"), ("user", "usermeta", "user_id")):
    register(f"join_acf_{name}", siblings(lambda s, table=table: getattr(s, table), owner), o.with_views(f"SELECT meta_id, coalesce({o.field(owner, table)}, false) AS field FROM {table} r", table))
register("join_parent", lambda s: ctx(s).join(s.owners.withColumnRenamed("id", "parent_id"), "parent_id").select("attachment_id", "parent_id", "post_type", "post_status"), o.with_views("SELECT attachment_id, parent_id, o.post_type, o.post_status FROM ctx JOIN owners o ON parent_id = o.id", context=True, owners=True))
register("join_anti_unscanned", lambda s: listing.filtered(s, "unscanned"), o.with_views("SELECT id AS attachment_id FROM attachments WHERE id NOT IN (SELECT attachment_id FROM results)", "results"))
register("join_semi_status", lambda s: listing.filtered(s, "used"), o.with_views("SELECT id AS attachment_id FROM attachments WHERE id IN (SELECT attachment_id FROM results WHERE status = 'used')", "results"))
NOTE = "CASE confidence WHEN 'confirmed' THEN '' WHEN 'info' THEN ' (record only — not a content reference)' ELSE ' (possible)' END"
SHOWN = "CASE WHEN object_type IN ('post', 'term', 'user') AND detail <> '' AND detail <> match THEN ' ' || detail ELSE '' END"
WHERE = "CASE object_type WHEN 'post' THEN coalesce(nullif(p.title, ''), '#' || object_id) WHEN 'term' THEN coalesce(t.name, 'term #' || object_id) WHEN 'user' THEN coalesce(u.display_name, 'user #' || object_id) WHEN 'theme_mod' THEN 'Customizer' ELSE detail END"
EVIDENCE = o.over_refs(f"SELECT attachment_id, {o.LABEL} || ' — ' || {WHERE} || {SHOWN} || {NOTE} AS evidence FROM refs LEFT JOIN (SELECT id, title FROM posts UNION ALL SELECT id, title FROM attachments) p ON object_type = 'post' AND object_id = p.id LEFT JOIN terms t ON object_type = 'term' AND object_id = t.term_id LEFT JOIN users u ON object_type = 'user' AND object_id = u.user_id", "terms", "users")
register("fn_evidence", lambda s: listing.evidence(s, references(s)), EVIDENCE)
register("join_display", lambda s: listing.evidence(s, detectors.termmeta(s, ctx(s)).unionByName(detectors.usermeta(s, ctx(s)))), EVIDENCE + " WHERE detector IN ('termmeta', 'usermeta')")

# Union, verdicts and counts
register("set_union_refs", lambda s: references(s).groupBy("ord", "detector", "match", "confidence").agg(F.count("*").alias("n")).select(F.col("ord").cast("long"), "detector", "match", "confidence", "n"), o.over_refs("SELECT CAST(ord AS BIGINT) AS ord, detector, match, confidence, count(*) AS n FROM refs GROUP BY ALL"))
VERDICT_COLUMNS = ("attachment_id", "status", "ref_count", "scanned_at")
register("agg_is_used", lambda s: scanned(s, NOW).select("attachment_id", "status"), o.over_refs(f"SELECT attachment_id, status FROM ({o.VERDICTS})"))
register("agg_is_used_raw", lambda s: scanned(from_raw(s), NOW).select("attachment_id", "status"), SQL["agg_is_used"])
register("agg_ref_count", lambda s: scanned(s, NOW).select("attachment_id", "ref_count"), o.over_refs(f"SELECT attachment_id, ref_count FROM ({o.VERDICTS})"))
KEPT_SQL = "SELECT attachment_id, CAST(place AS BIGINT) AS place, detector, object_type, object_id, detail, match, confidence FROM (SELECT *, row_number() OVER (PARTITION BY attachment_id ORDER BY ord, object_id, detail, match) - 1 AS place FROM refs) WHERE place < 20"
register("topk_refs", lambda s: results.decoded(scanned(s, NOW)).withColumn("place", F.col("place").cast("long")), o.over_refs(KEPT_SQL))
register("more_count", lambda s: scanned(s, NOW).select("attachment_id", F.greatest(F.lit(0), F.col("ref_count") - results.KEPT).alias("more")).where("more > 0"), o.over_refs(f"SELECT attachment_id, ref_count - 20 AS more FROM ({o.VERDICTS}) WHERE ref_count > 20"))
register("snk_save", lambda s: results.saved(s.results, scanned(s, NOW, ids=s.attachments.where("id % 3 = 0").select(F.col("id").alias("attachment_id")))).select(*VERDICT_COLUMNS), o.over_refs(f"SELECT attachment_id, status, ref_count, scanned_at FROM results WHERE attachment_id % 3 <> 0 UNION ALL SELECT attachment_id, status, ref_count, scanned_at FROM ({o.VERDICTS}) WHERE attachment_id % 3 = 0", "results"))


def stored(s: Site) -> DataFrame:
    """The results after a first save of all, a save of a third, and a clearing, in a stored table."""
    spark = s.results.sparkSession
    table = Results(spark, f"{shared_dir(spark)}/results-{uuid.uuid4().hex}", width=500)
    table.save(s.results)
    table.save(scanned(s, NOW + 10**9, ids=s.attachments.where("id % 3 = 0").select(F.col("id").alias("attachment_id"))))
    table.clear(s.attachments.where("post_status = 'trash'").select(F.col("id").alias("attachment_id")))
    return table.read().select(*VERDICT_COLUMNS)


register("snk_stored", stored, o.over_refs(f"SELECT * FROM (SELECT attachment_id, status, ref_count, scanned_at FROM results WHERE attachment_id % 3 <> 0 UNION ALL SELECT attachment_id, status, ref_count, CAST({NOW + 10**9} AS BIGINT) FROM ({o.VERDICTS}) WHERE attachment_id % 3 = 0) WHERE attachment_id NOT IN (SELECT id FROM attachments WHERE post_status = 'trash')", "results"))
register("snk_clear", lambda s: results.cleared(s.results, s.attachments.where("post_status = 'trash'").select(F.col("id").alias("attachment_id"))).select(*VERDICT_COLUMNS), o.with_views("SELECT attachment_id, status, ref_count, scanned_at FROM results WHERE attachment_id NOT IN (SELECT id FROM attachments WHERE post_status = 'trash')", "results"))
DECODED = "SELECT attachment_id, CAST(0 AS BIGINT) AS place, json_extract_string(refs_json, '$[0].d') AS detector, coalesce(json_extract_string(refs_json, '$[0].t'), 'post') AS object_type, coalesce(CAST(json_extract_string(refs_json, '$[0].i') AS BIGINT), 0) AS object_id, coalesce(json_extract_string(refs_json, '$[0].k'), '') AS detail, coalesce(json_extract_string(refs_json, '$[0].m'), 'exact') AS match, coalesce(json_extract_string(refs_json, '$[0].c'), 'possible') AS confidence FROM (SELECT * FROM results WHERE refs_json LIKE '[{%')"
register("snk_read_refs", lambda s: results.decoded(s.results).withColumn("place", F.col("place").cast("long")), o.with_views(DECODED, "results"))
ALIVE = "attachments a LEFT JOIN results r ON a.id = r.attachment_id WHERE a.post_status <> 'trash'"
COUNTS = f"SELECT count_if(status = 'used') AS used, count_if(status = 'unused') AS unused, greatest(0, count(*) - count_if(status = 'used') - count_if(status = 'unused')) AS unscanned, count(*) AS total FROM {ALIVE}"
register("agg_counts", lambda s: results.status_counts(s.attachments, s.results), o.with_views(f"SELECT CAST(used AS BIGINT) AS used, CAST(unused AS BIGINT) AS unused, CAST(unscanned AS BIGINT) AS unscanned, total FROM ({COUNTS})", "results"))
SAID = lambda c: f"count_if({o.COLLATED[c][0]('status')} = 'used') AS used, count_if({o.COLLATED[c][0]('status')} = 'unused') AS unused, count(*) AS total FROM attachments a LEFT JOIN results r ON a.id = r.attachment_id WHERE {o.COLLATED[c][0]('a.post_status')} <> 'trash'"
register("agg_counts_collated", by_collation(lambda s: results.status_counts(s.attachments, s.results, s.collation)), "\nUNION ALL\n".join("(" + o.with_views(f"SELECT CAST(used AS BIGINT) AS used, CAST(unused AS BIGINT) AS unused, CAST(total - used - unused AS BIGINT) AS unscanned, total, '{c}' AS collation FROM (SELECT {SAID(c)})", "results", collation=c) + ")" for c in COLLATIONS))
register("topk_unused_collated", by_collation(lambda s: listing.unused_ids(s, 40)), "\nUNION ALL\n".join("(" + o.with_views(f"SELECT a.id AS attachment_id, '{c}' AS collation FROM attachments a JOIN results r ON a.id = r.attachment_id WHERE {o.COLLATED[c][0]('r.status')} = 'unused' AND {o.COLLATED[c][0]('a.post_status')} <> 'trash' ORDER BY a.id LIMIT 40", "results", collation=c) + ")" for c in COLLATIONS))
for name in ("used", "unused", "unscanned", "total"):
    register(f"agg_{name}", lambda s, name=name: results.status_counts(s.attachments, s.results).select(F.col(name).alias("n")), o.with_views(f"SELECT CAST({name} AS BIGINT) AS n FROM ({COUNTS})", "results"))
register("agg_scan_total", lambda s: s.attachments.agg(F.count("*").alias("n")), o.with_views("SELECT count(*) AS n FROM attachments"))
register("agg_found", lambda s: listing.listed(s).agg(F.count("*").alias("n")), o.with_views(f"SELECT count(*) AS n FROM ({o.UNUSED}) WHERE post_status IN ('inherit', 'private')", "results"))
register("page_count", lambda s: listing.listed(s).agg(F.ceil(F.count("*") / listing.PAGE).alias("pages")), o.with_views(f"SELECT CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM ({o.UNUSED}) WHERE post_status IN ('inherit', 'private')", "results"))
register("agg_progress", lambda s: state.batches(s, 10).crossJoin(F.broadcast(s.attachments.agg(F.count("*").alias("total")))).select("batch", state.percent(F.col("done"), F.col("total")).alias("percent")), o.with_views("SELECT CAST(floor((n - 1) / 10) AS BIGINT) AS batch, CAST(least(100, floor(100 * max(n) / any_value(total) + 0.5)) AS BIGINT) AS percent FROM (SELECT row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS total FROM attachments) GROUP BY 1"))
register("agg_done_total", lambda s: state.batches(s, 10).select("batch", state.goal_shown(F.col("done"), F.lit(100)).alias("total")), o.with_views("SELECT CAST(floor((n - 1) / 10) AS BIGINT) AS batch, greatest(100, max(n)) AS total FROM (SELECT row_number() OVER (ORDER BY id) AS n FROM attachments) GROUP BY 1"))
register("st_batch", lambda s: state.batches(s, 10).select("batch", "cursor", F.col("done").cast("long")), o.with_views("SELECT CAST(floor((n - 1) / 10) AS BIGINT) AS batch, max(id) AS cursor, max(n) AS done FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM attachments) GROUP BY 1"))

# Paging and lists
register("topk_keyset", lambda s: listing.ids_after(s.attachments, 100, 10), o.with_views("SELECT id AS attachment_id FROM attachments WHERE id > 100 ORDER BY id LIMIT 10"))
register("topk_unused", lambda s: listing.unused_ids(s, 5), o.with_views(f"SELECT attachment_id FROM ({o.UNUSED}) WHERE post_status <> 'trash' ORDER BY attachment_id LIMIT 5", "results"))
PAGED = f"SELECT attachment_id, scanned_at FROM ({o.UNUSED}) WHERE post_status IN ('inherit', 'private') ORDER BY attachment_id LIMIT 50 OFFSET 50"
register("page_unused", lambda s: listing.unused_page(s, 2), o.with_views(PAGED, "results"))
SHOWN_AT = NOW + 200_000
BASE = "regexp_extract(attached_file, '[^/]*$')"
SEEN = f"CASE WHEN scanned_at > 0 THEN {o.difference('scanned_at', str(SHOWN_AT))} || ' ago' ELSE '—' END"
register("qry_unused_table", lambda s: listing.unused_table(s, 2, SHOWN_AT), o.with_views(f"SELECT attachment_id, title, file, mime, date, CASE WHEN b > 0 THEN {o.in_units('b')} ELSE '—' END AS size, {SEEN} AS scanned FROM (SELECT p.attachment_id, coalesce(nullif(title, ''), {BASE}) AS title, {BASE} AS file, mime, coalesce(strftime(created, '%B %-d, %Y'), '—') AS date, coalesce(size, filesize, 0) AS b, scanned_at FROM ({PAGED}) p JOIN attachments a ON a.id = p.attachment_id LEFT JOIN files f ON f.attachment_id = p.attachment_id)", "results", "files"))
register("qry_list_filter", lambda s: listing.filtered(s, "unused").withColumn("filter", F.lit("unused")).union(listing.filtered(s, "anything").withColumn("filter", F.lit("any"))), o.with_views("SELECT attachment_id, 'unused' AS filter FROM results WHERE status = 'unused' UNION ALL SELECT id, 'any' FROM attachments", "results"))
STATUS = "CASE WHEN status IN ('used', 'unused') THEN status END"
COUNTED = "CASE WHEN status = 'used' THEN ref_count ELSE 0 END"
BADGE = f"CASE WHEN status = 'used' THEN CASE WHEN ref_count = 0 THEN 'Used' WHEN ref_count = 1 THEN 'Used (1 reference)' ELSE 'Used (' || ref_count || ' references)' END WHEN status = 'unused' THEN 'Unused' ELSE 'Not scanned' END"
USAGE = o.with_views(f"SELECT id AS attachment_id, {STATUS} AS status, {COUNTED} AS shown, {BADGE} AS badge FROM attachments LEFT JOIN results ON id = attachment_id", "results")
register("qry_usage_column", listing.usage_column, USAGE)
register("fn_badge", lambda s: s.results.select("attachment_id", labels.badge(F.col("status"), F.col("ref_count")).alias("badge")), o.with_views(f"SELECT attachment_id, {BADGE} AS badge FROM results", "results"))
register("fn_match_label", lambda s: references(s).groupBy(labels.match_label(F.col("match")).alias("label")).agg(F.count("*").alias("n")), o.over_refs(f"SELECT {o.LABEL} AS label, count(*) AS n FROM refs GROUP BY 1"))
register("fn_title", lambda s: s.attachments.select("id", labels.title_of(F.col("title"), context.basename(F.col("attached_file")), F.col("id")).alias("title")), o.with_views("SELECT id, coalesce(nullif(title, ''), regexp_extract(attached_file, '[^/]*$')) AS title FROM attachments"))
register("fn_size", lambda s: listing.file_sizes(s).select("attachment_id", labels.size_text(F.col("bytes")).alias("size")), o.with_views(f"SELECT id AS attachment_id, {o.in_units('b')} AS size FROM (SELECT a.id, coalesce(f.size, a.filesize, 0) AS b FROM attachments a LEFT JOIN files f ON f.attachment_id = a.id)", "files"))
SPREAD = "scanned_at + attachment_id * attachment_id * 700"
register("fn_time", lambda s: s.results.select("attachment_id", labels.time_difference(F.expr(SPREAD), F.lit(NOW)).alias("difference"), labels.ago(F.when(F.col("attachment_id") % 5 != 0, F.col("scanned_at")).otherwise(0), F.lit(SHOWN_AT)).alias("ago")), o.with_views(f"SELECT attachment_id, {o.difference(SPREAD, str(NOW))} AS difference, CASE WHEN attachment_id % 5 <> 0 THEN {o.difference('scanned_at', str(SHOWN_AT))} || ' ago' ELSE '—' END AS ago FROM results", "results"))

# State, deletion and single checks
CHANGED = "SELECT CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) AS changed_at FROM changes WHERE post_type NOT IN ('revision', 'attachment')"
register("st_stale", lambda s: last_change(s.changes), o.with_views(CHANGED, "changes"))


def stored_change(s: Site) -> DataFrame:
    """The changes as a stream of files, in two runs from one checkpoint and one from the start again, into a stored marker."""
    spark = s.changes.sparkSession
    folder = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    marker = Marker(spark, f"{folder}/marker")
    late = F.xxhash64("post_id") % 2 == 0
    for half, checkpoint in ((s.changes.where(late), "one"), (s.changes.where(~late | F.col("post_id").isNull()), "one"), (None, "two")):
        if half is not None:
            half.write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(s.changes.schema).parquet(f"{folder}/log")
        follow(stream, marker, f"{folder}/{checkpoint}").awaitTermination()
    return marker.read()


register("st_stale_stored", stored_change, o.with_views(CHANGED, "changes"))
register("st_is_stale", lambda s: s.results.select("attachment_id", is_stale(F.lit(NOW + 30_000), F.col("scanned_at")).alias("stale")), o.with_views(f"SELECT attachment_id, {NOW + 30_000} > scanned_at AS stale FROM results", "results"))
RUNNING = "SELECT cursor, done, total, started_at FROM scan_log WHERE kind = 'running' AND seq = (SELECT max(seq) FROM scan_log)"
LAST = "SELECT finished_at, scanned, unused FROM scan_log WHERE kind = 'finished' ORDER BY seq DESC LIMIT 1"
NOTE_SQL = f"'Last full scan finished ' || {o.difference('finished_at', str(SHOWN_AT))} || ' ago (' || {o.thousands('scanned')} || ' files).' || CASE WHEN changed_at > finished_at THEN ' Content has changed since — results may be stale.' ELSE '' END"
BUTTON = f"CASE WHEN r.done IS NULL THEN 'Start full scan' ELSE 'Resume scan (' || {o.thousands('r.done')} || ' / ' || {o.thousands('r.total')} || ')' END"
register("qry_scan_card", lambda s: listing.scan_card(s, state.current_of(s.scan_log), state.last_of(s.scan_log), last_change(s.changes), SHOWN_AT), o.with_views(f"SELECT CAST(used AS BIGINT) AS used, CAST(c.unused AS BIGINT) AS unused, CAST(unscanned AS BIGINT) AS unscanned, c.total, {NOTE_SQL} AS note, {BUTTON} AS button FROM ({COUNTS}) c LEFT JOIN ({RUNNING}) r ON true LEFT JOIN ({LAST}) l ON true LEFT JOIN ({CHANGED}) h ON true", "results", "changes", "scan_log"))
register("st_current", lambda s: state.current_of(s.scan_log), o.with_views(RUNNING, "scan_log"))
register("st_last", lambda s: state.last_of(s.scan_log), o.with_views(LAST, "scan_log"))
LATER = "SELECT CAST(seq AS BIGINT) AS seq, kind, CAST(cursor AS BIGINT) AS cursor, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total, CAST(started_at AS BIGINT) AS started_at, CAST(finished_at AS BIGINT) AS finished_at, CAST(scanned AS BIGINT) AS scanned, CAST(unused AS BIGINT) AS unused FROM ({} FROM (SELECT max(seq) + 1 AS n, arg_max(cursor, seq) AS c, arg_max(done, seq) AS d, arg_max(total, seq) AS t, arg_max(started_at, seq) AS a FROM scan_log))"


def next_row(kind: str, step: Callable[[Site, state.State | None], tuple[state.State | None, state.LastScan | None]]) -> Query:
    """The log's new last row after a step from the current state."""

    def query(s: Site) -> DataFrame:
        row = state.current_of(s.scan_log).first()  # one row at most
        log = state.with_row(s.scan_log, kind, *step(s, state.State(*row) if row else None))
        end = F.broadcast(log.agg(F.max("seq").alias("seq")))  # one row
        return log.join(end, "seq")

    return query


def advanced(s: Site, current: state.State | None) -> tuple[state.State, None]:
    ids = [r[0] for r in state.next_batch(s, current or state.State(), 10).collect()]
    return state.advanced(current, ids[-1] if ids else 0, len(ids), NOW), None


register("st_start", next_row("running", lambda s, current: (state.started(s.attachments.count(), NOW), None)), o.with_views(LATER.format(f"SELECT n AS seq, 'running' AS kind, 0 AS cursor, 0 AS done, (SELECT count(*) FROM attachments) AS total, {NOW} AS started_at, NULL AS finished_at, NULL AS scanned, NULL AS unused"), "scan_log"))
AFTER = "(SELECT * FROM attachments WHERE id > (SELECT arg_max(cursor, seq) FROM scan_log) ORDER BY id LIMIT 10)"
register("st_advance", next_row("running", advanced), o.with_views(LATER.format(f"SELECT n AS seq, 'running' AS kind, coalesce((SELECT max(id) FROM {AFTER}), 0) AS cursor, d + (SELECT count(*) FROM {AFTER}) AS done, t AS total, a AS started_at, NULL AS finished_at, NULL AS scanned, NULL AS unused"), "scan_log"))
register("st_finish", next_row("finished", lambda s, current: (None, state.finished(current, results.status_counts(s.attachments, s.results).first()["unused"], NOW)[1])), o.with_views(LATER.format(f"SELECT n AS seq, 'finished' AS kind, NULL AS cursor, NULL AS done, NULL AS total, NULL AS started_at, {NOW} AS finished_at, d AS scanned, (SELECT unused FROM ({COUNTS})) AS unused"), "results", "scan_log"))
register("st_reset", lambda s: state.current_of(state.with_row(s.scan_log, "reset")).agg(F.count("*").alias("running")).crossJoin(F.broadcast(state.last_of(state.with_row(s.scan_log, "reset")))), o.with_views(f"SELECT CAST(0 AS BIGINT) AS running, finished_at, scanned, unused FROM ({LAST})", "scan_log"))
LINE = f"{o.LABEL} || ' — ' || {WHERE} || {SHOWN} || {NOTE}"
LINES = f"SELECT attachment_id, string_agg({LINE}, chr(10) ORDER BY place) AS lines FROM ({KEPT_SQL}) r LEFT JOIN (SELECT id, title FROM posts UNION ALL SELECT id, title FROM attachments) p ON object_type = 'post' AND object_id = p.id LEFT JOIN terms t ON object_type = 'term' AND object_id = t.term_id LEFT JOIN users u ON object_type = 'user' AND object_id = u.user_id GROUP BY attachment_id"


def checked(s: Site) -> DataFrame:
    ids = s.attachments.sparkSession.createDataFrame([(4,), (5,), (0,), (99_999_999,)], "attachment_id long")
    return listing.checked(s, ids, scanned_few(s, ids, NOW))


register("qry_check", checked, o.over_refs(f"SELECT x.id AS attachment_id, CASE WHEN status IS NULL THEN 'refused' ELSE 'checked' END AS outcome, status, CASE WHEN status IS NOT NULL THEN {BADGE} END AS badge, CASE WHEN status IS NOT NULL THEN coalesce(lines, 'No references found anywhere.') END AS evidence FROM (VALUES (CAST(4 AS BIGINT)), (5), (0), (99999999)) x(id) LEFT JOIN ({o.VERDICTS}) v ON v.attachment_id = x.id LEFT JOIN ({LINES}) e ON e.attachment_id = x.id", "terms", "users"))
register("udf_detectors", lambda s: scanned(s, NOW, detectors={"attached": detectors.attached, "termmeta": lambda site, known: detectors.termmeta(site, known).withColumn("detector", F.lit("own"))}).select("attachment_id", "status", "ref_count"), o.over_refs("SELECT c.attachment_id, CASE WHEN coalesce(bool_or(confidence <> 'info'), false) THEN 'used' ELSE 'unused' END AS status, count(r.attachment_id) AS ref_count FROM ctx c LEFT JOIN (SELECT * FROM refs WHERE detector IN ('attached', 'termmeta')) r ON c.attachment_id = r.attachment_id GROUP BY c.attachment_id"))
register("udf_is_used", lambda s: scanned(s, NOW, is_used=lambda used, rows: used & (F.coalesce("ref_count", F.lit(0)) > 2)).select("attachment_id", "status"), o.over_refs(f"SELECT attachment_id, CASE WHEN status = 'used' AND ref_count > 2 THEN 'used' ELSE 'unused' END AS status FROM ({o.VERDICTS})"))
register("udf_batch_size", lambda s: state.batches(s, -3).select("batch", "cursor", F.col("done").cast("long")), o.with_views("SELECT row_number() OVER (ORDER BY id) - 1 AS batch, id AS cursor, row_number() OVER (ORDER BY id) AS done FROM attachments"))
register("src_request", lambda s: s.postmeta.select("meta_id", deletion.requested_keys(F.col("meta_key")).alias("key")), o.with_views("SELECT meta_id, regexp_replace(lower(coalesce(meta_key, '')), '[^a-z0-9_-]', '', 'g') AS key FROM postmeta", "postmeta"))
register("snk_latest", lambda s: results.latest(s.results.withColumn("batch", F.lit(1)).unionByName(s.results.withColumn("batch", F.lit(2)).withColumn("scanned_at", F.col("scanned_at") + F.when(F.col("attachment_id") % 2 == 0, 60).otherwise(-60)).withColumn("ref_count", F.lit(7).cast("long")))).select(*VERDICT_COLUMNS), o.with_views("SELECT attachment_id, status, CASE WHEN attachment_id % 2 = 0 THEN 7 ELSE ref_count END AS ref_count, CASE WHEN attachment_id % 2 = 0 THEN scanned_at + 60 ELSE scanned_at END AS scanned_at FROM results", "results"))


def tried(s: Site, requests: DataFrame, deletable: DataFrame) -> DataFrame:
    ids = requests.select("attachment_id").distinct()
    return deletion.tried(s, chosen(s, ids), requests, references(s, ids), deletable, NOW)


def deletable_ids(s: Site) -> DataFrame:
    return s.attachments.where("id % 7 <> 0").select(F.col("id").alias("attachment_id"))


def every_unused(s: Site) -> DataFrame:
    return tried(s, deletion.numbered(s.results.where("status = 'unused'").select("attachment_id")), deletable_ids(s))


def in_turn(asked: str, select: str, may: str = "true") -> str:
    """A loop over requests (n, id): what is gone by then, and what comes of each."""
    loop = f"""asked AS ({asked}), holders AS MATERIALIZED (
  SELECT attachment_id AS id, list(DISTINCT CASE WHEN object_type = 'post' THEN object_id ELSE -1 END) AS held FROM refs WHERE confidence <> 'info' GROUP BY 1
), asks AS MATERIALIZED (SELECT q.n, q.id, a.id IS NOT NULL AND {may} AS may, coalesce(held, []) AS held FROM asked q LEFT JOIN attachments a ON a.id = q.id LEFT JOIN holders h ON h.id = q.id
), turn AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS outcome, CAST([] AS BIGINT[]) AS before, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT n, id, outcome, gone, CASE WHEN outcome = 'deleted' THEN list_append(gone, id) ELSE gone END FROM (
    SELECT a.n, a.id, t.gone, CASE WHEN NOT a.may OR list_contains(t.gone, a.id) THEN 'failed' WHEN len(list_filter(a.held, lambda x: NOT list_contains(t.gone, x))) > 0 THEN 'skipped' ELSE 'deleted' END AS outcome
    FROM turn t JOIN asks a ON a.n = t.n + 1)
), done AS MATERIALIZED (SELECT n, id AS attachment_id, outcome, before FROM turn WHERE n > 0)"""
    return o.over_refs(f"SELECT * FROM asks", "results").replace("SELECT * FROM asks", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f",\n{loop}\n{select}"


UNUSED_ASKED = "SELECT row_number() OVER (ORDER BY attachment_id) AS n, attachment_id AS id FROM results WHERE status = 'unused'"
BY_TURN = "SELECT n, attachment_id, outcome FROM done"
OUTCOME = ("n", "attachment_id", "outcome")
register("mut_delete", lambda s: every_unused(s).select(*OUTCOME), in_turn(UNUSED_ASKED, BY_TURN, "q.id % 7 <> 0"))
register("agg_delete_tally", lambda s: deletion.tally(every_unused(s)), in_turn(UNUSED_ASKED, f"SELECT {', '.join(f'CAST(count_if(outcome = {chr(39)}{x}{chr(39)}) AS BIGINT) AS {x}' for x in ('deleted', 'skipped', 'failed'))} FROM done", "q.id % 7 <> 0"))
AFTER = """SELECT a.id AS attachment_id, coalesce(f.status, r.status) AS status, coalesce(f.ref_count, r.ref_count) AS ref_count
FROM attachments a LEFT JOIN (SELECT * FROM results WHERE attachment_id NOT IN (SELECT attachment_id FROM done)) r ON a.id = r.attachment_id LEFT JOIN (
  SELECT d.attachment_id, any_value('used') AS status, count(*) AS ref_count FROM done d JOIN refs x ON x.attachment_id = d.attachment_id AND NOT (object_type = 'post' AND list_contains(d.before, object_id)) WHERE outcome = 'skipped' GROUP BY 1
) f ON a.id = f.attachment_id WHERE a.id NOT IN (SELECT attachment_id FROM done WHERE outcome = 'deleted')"""


def after_deletion(s: Site) -> DataFrame:
    left = deletion.applied(s, every_unused(s))
    return left.attachments.select(F.col("id").alias("attachment_id")).join(left.results.select("attachment_id", "status", "ref_count"), "attachment_id", "left")


register("mut_applied", after_deletion, in_turn(UNUSED_ASKED, AFTER, "q.id % 7 <> 0"))


def after_rounds(s: Site) -> DataFrame:
    """The site after rounds until nothing unused is left; any size of rounds gives the same."""
    spark = s.results.sparkSession
    folder = f"{shared_dir(spark)}/deletion-{uuid.uuid4().hex}"
    for _ in cleanup.delete_unused(s, folder, deletable_ids(s), NOW, size=10_000):
        pass
    left = cleanup.after(s, folder)
    return left.attachments.select(F.col("id").alias("attachment_id")).join(left.results.select("attachment_id", "status", "ref_count"), "attachment_id", "left")


POOL = f"SELECT row_number() OVER (ORDER BY attachment_id) AS n, attachment_id AS id FROM ({o.UNUSED}) WHERE post_status <> 'trash'"
register("mut_delete_rounds", after_rounds, in_turn(POOL, AFTER, "q.id % 7 <> 0"))
register("mut_delete_batch", lambda s: tried(s, deletion.numbered(deletion.next_batch(s)), s.attachments.select(F.col("id").alias("attachment_id"))).select(*OUTCOME), in_turn(f"SELECT row_number() OVER (ORDER BY attachment_id) AS n, attachment_id AS id FROM (SELECT attachment_id FROM ({o.UNUSED}) WHERE post_status <> 'trash' ORDER BY attachment_id LIMIT 5)", BY_TURN))


def selected(s: Site) -> DataFrame:
    ids = deletion.requested(["7", "-12", "abc", 0, "7", "99999999", "31x", "1.2e1", "\u00b2", "5", "5"])
    requests = s.attachments.sparkSession.createDataFrame(list(enumerate(ids, 1)), "n long, attachment_id long")
    return tried(s, requests, s.attachments.select(F.col("id").alias("attachment_id"))).select(*OUTCOME)


register("mut_delete_selected", selected, in_turn("SELECT CAST(n AS BIGINT) AS n, CAST(id AS BIGINT) AS id FROM (VALUES (1, 7), (2, 12), (3, 7), (4, 99999999), (5, 31), (6, 12), (7, 5), (8, 5)) x(n, id)", BY_TURN))
register("mut_uninstall", lambda s: deletion.uninstalled(s)[1].groupBy("meta_key").agg(F.count("*").alias("n")), o.with_views("SELECT meta_key, count(*) AS n FROM postmeta WHERE coalesce(meta_key NOT IN ('_refscan_status', '_refscan_refs', '_refscan_scanned_at'), true) GROUP BY meta_key", "postmeta"))


# Rights
def asked(s: Site) -> DataFrame:
    action = F.expr("CASE meta_id % 4 WHEN 0 THEN 'check' WHEN 1 THEN 'scan' WHEN 2 THEN 'delete' ELSE 'other' END")
    return s.postmeta.select(F.col("meta_id").alias("n"), F.expr("meta_id % 300").alias("user_id"), action.alias("action"), F.expr("CAST(floor(meta_id / 300) % 50 AS BIGINT)").alias("attachment_id"))


def authors(s: Site) -> DataFrame:
    return s.attachments.select(F.col("id").alias("attachment_id"), F.expr("CASE WHEN id % 3 > 0 THEN id % 9 END").alias("author"))


GIVEN = lambda *names: "(" + " OR ".join(f"contains(v, '\"{x}\";b:1;')" for x in names) + ")"
RIGHTS = f"""rights AS (SELECT user_id, {GIVEN('administrator', 'editor', 'author', 'upload_files')} AND NOT contains(v, '"upload_files";b:0;') AS upload, {GIVEN('administrator', 'manage_options')} AS manage, {GIVEN('administrator', 'editor')} AS others, {GIVEN('administrator', 'editor', 'author')} AS own
  FROM (SELECT user_id, min_by(meta_value, meta_id) AS v FROM usermeta WHERE meta_key = 'wp_capabilities' GROUP BY user_id))"""
AUTHORS = "authors AS (SELECT id AS attachment_id, CASE WHEN id % 3 > 0 THEN id % 9 END AS author FROM attachments)"
MAY = "coalesce(CASE action WHEN 'check' THEN upload WHEN 'scan' THEN manage WHEN 'delete' THEN manage AND (others OR own AND coalesce(author = q.user_id, false)) END, false)"


def with_rights(select: str) -> str:
    return o.with_views("", "usermeta", "postmeta").rstrip() + f",\n{RIGHTS},\n{AUTHORS}\n{select}"


register("auth", lambda s: rights.allowed(asked(s), rights.granted(s), authors(s)), with_rights(f"SELECT n, q.user_id, action, q.attachment_id, {MAY} AS allowed FROM (SELECT meta_id AS n, meta_id % 300 AS user_id, CASE meta_id % 4 WHEN 0 THEN 'check' WHEN 1 THEN 'scan' WHEN 2 THEN 'delete' ELSE 'other' END AS action, CAST(floor(meta_id / 300) % 50 AS BIGINT) AS attachment_id FROM postmeta) q LEFT JOIN rights r ON r.user_id = q.user_id LEFT JOIN authors a ON a.attachment_id = q.attachment_id"))
register("auth_deletable", lambda s: reduce(DataFrame.unionByName, (rights.deletable(s, rights.granted(s), user, authors(s)).withColumn("user_id", F.lit(user).cast("long")) for user in (3, 5, 7, 8, 99_999))), with_rights(f"SELECT q.attachment_id, q.user_id FROM (SELECT a.id AS attachment_id, u.user_id, 'delete' AS action FROM attachments a, (VALUES (CAST(3 AS BIGINT)), (5), (7), (8), (99999)) u(user_id)) q LEFT JOIN rights r ON r.user_id = q.user_id LEFT JOIN authors a ON a.attachment_id = q.attachment_id WHERE {MAY}"))


def of_folder(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(fixtures.site(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: of_folder(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
