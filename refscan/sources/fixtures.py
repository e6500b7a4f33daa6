"""A site derived by fixed arithmetic from the star-schema test tables, in SQL that Spark and DuckDB both read.

The test tables hold no media references. Each view is (source table, {column: expression}, filter). ``@IDS@`` and
``@DOCS@`` stand for numbers that grow with the tables: half as many again as attachments, and posts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .site import Collation, Site

NOW = 1_700_000_000


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def case(of: str, *values: str) -> str:
    """One of the values, by a number from 0."""
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


PART, DOC, ORDER, SUPP = "p_partkey", "doc_id", "o_orderkey", "s_suppkey"
STEM = f"replace(p_name, ' ', '-') || '-' || {text('p_partkey + 1')}"
POST_T = text("(doc_id * 7) % @IDS@ + 1")
META_T = text("o_custkey % @IDS@ + 1")
USER_V = text("c_custkey % @IDS@ + 1")
# A user's roles as they are stored; a role may be there and not be given.
ROLES = (
    "'a:1:{s:13:\"administrator\";b:1;}'", "'a:1:{s:6:\"editor\";b:1;}'", "'a:2:{s:6:\"editor\";b:0;s:6:\"author\";b:1;}'", "'a:2:{s:10:\"subscriber\";b:1;s:12:\"upload_files\";b:1;}'",
    "'none'", "'a:2:{s:6:\"author\";b:1;s:14:\"manage_options\";b:1;}'", "'a:2:{s:6:\"editor\";b:1;s:12:\"upload_files\";b:0;}'",
)
OPTION_V = text("p_partkey % @IDS@ + 1")

VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "attachments": ("part", {
        "id": "CAST(p_partkey + 1 AS BIGINT)",
        "post_status": "CASE WHEN p_partkey % 17 = 0 THEN 'trash' WHEN p_partkey % 5 = 0 THEN 'private' ELSE 'inherit' END",
        "post_parent": "CAST(CASE WHEN p_partkey % 3 = 0 THEN 1000000 + p_partkey ELSE 0 END AS BIGINT)",
        "title": "CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_name END",
        "created": "CASE WHEN p_partkey % 11 <> 0 THEN DATE '2024-01-01' + CAST(p_partkey % 700 AS INT) END",
        "mime": "CASE WHEN p_partkey % 7 = 0 THEN 'image/png' ELSE 'image/jpeg' END",
        "stem": STEM,
        "attached_file": f"'2024/' || lpad({text('p_partkey % 12 + 1')}, 2, '0') || '/' || {STEM} || CASE p_partkey % 4 WHEN 0 THEN '-scaled' WHEN 1 THEN '-300x200' ELSE '' END || '.jpg'",
        "original_image": f"CASE WHEN p_partkey % 4 = 0 THEN {STEM} || '.jpg' END",
        "size_thumb": f"{STEM} || '-150x150.jpg'",
        "filesize": "CAST(p_size * 1024 AS BIGINT)",
    }, "true"),
    "posts": ("documents", {
        "id": "CAST(1000000 + doc_id AS BIGINT)",
        "post_type": case("CASE WHEN doc_id % 13 > 5 THEN 6 ELSE doc_id % 13 END", "'revision'", "'nav_menu_item'", "'page'", "'page'", "'page'", "'page'", "'post'"),
        "post_status": case("CASE WHEN doc_id % 11 > 1 THEN 2 ELSE doc_id % 11 END", "'trash'", "'auto-draft'", "'publish'"),
        "title": f"CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'Post ' || {text('doc_id')} END",
        "post_content": "coalesce(text, '') || ' ' || " + case(
            "doc_id % 9",
            f"'<img class=\"wp-image-' || {POST_T} || '\">'", f"'<!-- wp:image {{\"id\":' || {POST_T} || '}} -->'", f"'<!-- wp:gallery {{\"ids\":[4,' || {POST_T} || ',9]}} -->'",
            f"'[gallery ids=\"4,' || {POST_T} || ',9\"]'", f"'[gallery ids=''' || {POST_T} || ',9'']'", f"'<a href=\"/u/' || {text('(doc_id * 7) % @IDS@ + 1')} || '.jpg\">'",
            f"'{{\"id\": ' || {POST_T} || '}}'", f"'\"ids\":[4, ' || {POST_T} || ']'", "''"),
    }, "true"),
    "postmeta": ("orders", {
        "meta_id": "CAST(o_orderkey AS BIGINT)",
        "post_id": "CAST(CASE WHEN o_orderkey % 14 = 13 THEN o_custkey % @IDS@ + 1 ELSE 1000000 + floor(o_orderkey / 14) % @DOCS@ END AS BIGINT)",
        "meta_key": case("o_orderkey % 14", "'_thumbnail_id'", "'_product_image_gallery'", "'_elementor_data'", "'hero_image'", "'_hero_image'", "'gallery'", "'_edit_lock'", "'url_field'", "'packed'", "'json_field'", "'related_id'", "'id_list'", "CASE WHEN o_orderkey % 28 = 12 THEN CAST(NULL AS STRING) ELSE '_refscan_status' END", "'related_id'"),
        "meta_value": case(
            "o_orderkey % 14",
            META_T, f"'4,' || {META_T} || ',9'", f"'[{{\"id\":' || {META_T} || '}}]'", META_T, "'field_abc'", f"'a:1:{{i:0;s:' || {text(f'length({META_T})')} || ':\"' || {META_T} || '\";}}'", META_T,
            f"'/u/' || {META_T} || '-150x150.jpg'", f"'a:1:{{i:0;i:' || {META_T} || ';}}'", f"CASE WHEN o_orderkey % 28 = 9 THEN '{{\"id\": ' || {META_T} || '}}' WHEN o_orderkey % 3 = 0 THEN '{{\"id\":\"' || {META_T} || '\"}}' ELSE '{{\"id\":' || {META_T} || '}}' END",
            META_T, f"'4,' || {META_T} || ', 9'", META_T, f"CASE WHEN o_orderkey % 3 = 0 THEN {text('o_custkey % @IDS@ + 2')} ELSE {META_T} END"),
    }, "true"),
    "options": ("part", {
        "option_id": "CAST(p_partkey AS BIGINT)",
        "option_name": case("p_partkey % 9", "CASE WHEN p_partkey % 2 = 0 THEN 'site_icon' ELSE 'site_logo' END", f"'theme_mods_t' || {text('p_partkey')}", f"'widget_w' || {text('p_partkey')}", f"'_transient_x' || {text('p_partkey')}", f"'opt_' || {text('p_partkey')}", f"'json_' || {text('p_partkey')}", "'cron'", f"'widget_v' || {text('p_partkey')}", f"'url_' || {text('p_partkey')}"),
        "option_value": case("p_partkey % 9", OPTION_V, f"'a:1:{{s:11:\"custom_logo\";i:' || {OPTION_V} || ';}}'", f"'a:1:{{i:' || {OPTION_V} || ';s:1:\"x\";}}'", OPTION_V, f"'a:1:{{i:0;i:' || {OPTION_V} || ';}}'", f"'{{\"id\":' || {OPTION_V} || '}}'", OPTION_V, f"'a:1:{{s:2:\"id\";i:' || {OPTION_V} || ';}}'", f"'/u/' || {OPTION_V} || '-150x150.jpg'"),
    }, "true"),
    "termmeta": ("nation", {"meta_id": "CAST(n_nationkey AS BIGINT)", "term_id": "CAST(n_regionkey + 1 AS BIGINT)", "meta_key": case("n_nationkey % 3", "'image'", "'_image'", "'thumbnail_id'"), "meta_value": case("n_nationkey % 3", text("n_nationkey + 1"), "'field_t'", text("n_nationkey + 1"))}, "true"),
    "usermeta": ("customer", {
        "meta_id": "CAST(c_custkey AS BIGINT)",
        "user_id": "CAST(floor(c_custkey / 6) + 1 AS BIGINT)",
        "meta_key": case("c_custkey % 6", "'avatar'", "'_avatar'", "'wp_capabilities'", "'session_tokens'", "'wp_user-settings-time'", "'ids'"),
        "meta_value": case("c_custkey % 6", USER_V, "CASE WHEN c_custkey % 4 = 1 THEN 'field_u' ELSE 'x' END", case("c_custkey % 7", *ROLES), USER_V, USER_V, f"{USER_V} || ',7'"),
    }, "true"),
    "terms": ("region", {"term_id": "CAST(r_regionkey + 1 AS BIGINT)", "name": "r_name"}, "r_regionkey < 4"),
    "users": ("customer", {"user_id": "CAST(c_custkey AS BIGINT)", "display_name": "c_name"}, "c_custkey % 4 <> 3"),
    "files": ("part", {"attachment_id": "CAST(p_partkey + 1 AS BIGINT)", "size": "CASE WHEN p_partkey % 8 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(p_size AS BIGINT) * 1000 * CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 77 ELSE 1000001 END END"}, "p_partkey % 2 = 0"),
    "results": ("part", {
        "attachment_id": "CAST(p_partkey + 1 AS BIGINT)",
        "status": case("CASE WHEN p_partkey % 6 < 3 THEN p_partkey % 6 ELSE 3 END", "'used'", "'garbage'", "'used'", "'unused'"),
        "ref_count": "CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 30 ELSE 0 END AS BIGINT)",
        "refs_json": case("p_partkey % 4", "'[{\"d\":\"content\",\"t\":\"post\",\"i\":' || " + text("p_partkey") + " || ',\"k\":\"gallery\",\"m\":\"gallery\",\"c\":\"confirmed\"}]'", "'[{\"d\":\"options\"}]'", "'not json'", "'[]'"),
        "scanned_at": f"CAST({NOW} + p_partkey * 60 AS BIGINT)",
    }, "p_partkey % 10 <> 9"),
    "scan_log": ("nation", {
        "seq": "CAST(n_nationkey AS BIGINT)",
        "kind": case("n_nationkey % 6", "'running'", "'running'", "'finished'", "'running'", "'reset'", "'running'"),
        "cursor": "CAST(CASE WHEN n_nationkey % 6 IN (2, 4) THEN NULL ELSE n_nationkey * 10 END AS BIGINT)",
        "done": "CAST(CASE WHEN n_nationkey % 6 IN (2, 4) THEN NULL ELSE n_nationkey * 500 END AS BIGINT)",
        "total": "CAST(CASE WHEN n_nationkey % 6 IN (2, 4) THEN NULL ELSE 20000 END AS BIGINT)",
        "started_at": f"CAST(CASE WHEN n_nationkey % 6 IN (2, 4) THEN NULL ELSE {NOW} END AS BIGINT)",
        "finished_at": f"CAST(CASE WHEN n_nationkey % 6 = 2 THEN {NOW} - n_nationkey * 4000 END AS BIGINT)",
        "scanned": "CAST(CASE WHEN n_nationkey % 6 = 2 THEN n_nationkey * 900 END AS BIGINT)",
        "unused": "CAST(CASE WHEN n_nationkey % 6 = 2 THEN n_nationkey END AS BIGINT)",
    }, "true"),
    "changes": ("events", {"post_id": "CAST(user_id AS BIGINT)", "post_type": "CASE event_type WHEN 'view' THEN 'revision' WHEN 'error' THEN 'attachment' ELSE 'post' END", "ts": "ts"}, "true"),
}

# A page's link and a meta URL name an attachment's file, so that file names match: their number is its place in the stems.
LINKED = {"posts": ("post_content", "/u/"), "postmeta": ("meta_value", "/u/"), "options": ("option_value", "/u/")}


_sizes: dict[tuple[str, str], dict[str, str]] = {}


def sizes(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Of the numbers that grow with the tables; counted once for a folder in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sizes:
        _sizes[key] = counted(spark, sf_dir)
    return _sizes[key]


def counted(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    n = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    return {"@IDS@": str(n("part") * 3 // 2), "@DOCS@": str(n("documents"))}


def view(spark: SparkSession, sf_dir: str, name: str, numbers: dict[str, str]) -> DataFrame:
    source, columns, keep = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").where(keep).selectExpr(*(f"{with_numbers(e, numbers)} AS `{c}`" for c, e in columns.items()))


def with_numbers(expression: str, numbers: dict[str, str]) -> str:
    for mark, number in numbers.items():
        expression = expression.replace(mark, number)
    return expression


def site(spark: SparkSession, sf_dir: str) -> Site:
    numbers = sizes(spark, sf_dir)
    views = {name: view(spark, sf_dir, name, numbers) for name in VIEWS}
    stems = views["attachments"].select(F.concat(F.lit("/u/"), F.col("id").cast("string")).alias("number"), "stem")
    for name, (column, mark) in LINKED.items():
        table = views[name].withColumn("number", F.regexp_extract(column, f"{mark}[0-9]+", 0))
        linked = table.join(stems, "number", "left")
        views[name] = linked.withColumn(column, F.when(F.col("stem").isNotNull(), F.expr(f"replace({column}, number, '/u/' || stem)")).otherwise(F.col(column))).select(*views[name].columns)
    sizes_of = F.create_map(F.lit("thumbnail"), F.struct(F.col("size_thumb").alias("file")))
    views["attachments"] = views["attachments"].withColumn("sizes", sizes_of).drop("stem", "size_thumb")
    return Site(**views)


def uneven(of: str, key: str) -> str:
    """A text with other cases or blanks at its end in three of four rows."""
    return f"CASE {key} % 4 WHEN 0 THEN {of} WHEN 1 THEN upper({of}) WHEN 2 THEN {of} || '  ' ELSE upper({of}) || ' ' END"


#: Columns of tables whose texts differ from the words that are compared with them by case or blanks at the end.
UNEVEN = {
    "attachments": {"post_status": uneven("post_status", "id")},
    "posts": {"post_type": uneven("post_type", "id"), "post_status": uneven("post_status", "id")},
    "postmeta": {"meta_key": uneven("meta_key", "meta_id"), "meta_value": "CASE WHEN meta_id % 3 = 0 THEN meta_value || '  ' ELSE meta_value END"},
    "options": {"option_name": uneven("option_name", "option_id")},
    "usermeta": {"meta_key": uneven("meta_key", "meta_id")},
    "results": {"status": uneven("status", "attachment_id")},
}


def unevened(site: Site, collation: Collation) -> Site:
    changed = {name: getattr(site, name).withColumns({c: F.expr(e) for c, e in columns.items()}) for name, columns in UNEVEN.items()}
    return replace(site, collation=collation, **changed)


def raw(site: Site) -> dict[str, DataFrame]:
    """The site as raw tables: attachments are posts, their files and results are serialized in meta rows."""
    text = lambda c: F.concat(F.lit("s:"), F.octet_length(c).cast("string"), F.lit(':"'), c, F.lit('";'))
    entry = lambda key, value: F.concat(text(F.lit(key)), value)
    array = lambda n, *parts: F.concat(F.lit(f"a:{n}:{{") if isinstance(n, int) else F.concat(F.lit("a:"), n, F.lit(":{")), *parts, F.lit("}"))
    file, original = F.coalesce("attached_file", F.lit("")), F.col("original_image")
    size = F.concat(entry("width", F.lit("i:150;")), entry("file", text(F.element_at("sizes", F.lit("thumbnail"))["file"])), entry("scale", F.lit("d:1.5;")))
    parts = [entry("file", text(file)), entry("sizes", array(1, entry("thumbnail", array(3, size)))), F.when(original.isNotNull(), entry("original_image", text(original))).otherwise(""), entry("filesize", F.concat(F.lit("i:"), F.col("filesize").cast("string"), F.lit(";"))), entry("image_meta", array(1, entry("aperture", F.lit("b:0;"))))]
    metadata = array(F.when(original.isNotNull(), "5").otherwise("4"), *parts)
    row = lambda n, key, value: F.struct((F.lit(10**9 + n) + F.col("id") * 10).alias("meta_id"), F.lit(key).alias("meta_key"), value.alias("meta_value"))
    # A second row of a key never counts.
    own = F.explode(F.array(row(2, "_wp_attached_file", F.lit("other.jpg")), row(1, "_wp_attached_file", file), row(3, "_wp_attachment_metadata", metadata)))
    meta = site.attachments.select(F.col("id").alias("post_id"), own.alias("x")).select("x.meta_id", "post_id", "x.meta_key", "x.meta_value")
    stored = F.concat(F.lit('{"count":'), F.col("ref_count").cast("string"), F.lit(',"refs":'), F.when(F.startswith("refs_json", F.lit("[")), F.col("refs_json")).otherwise("null"), F.lit("}"))
    said = lambda n, key, value: F.struct((F.lit(2 * 10**9 + n) + F.col("attachment_id") * 10).alias("meta_id"), F.lit(key).alias("meta_key"), value.alias("meta_value"))
    results = site.results.select(F.col("attachment_id").alias("post_id"), F.explode(F.array(said(1, "_refscan_status", F.col("status")), said(2, "_refscan_refs", stored), said(3, "_refscan_scanned_at", F.col("scanned_at").cast("string")))).alias("x")).select("x.meta_id", "post_id", "x.meta_key", "x.meta_value")
    posts = site.posts.select(F.col("id").alias("ID"), "post_type", "post_status", F.lit(0).cast("long").alias("post_parent"), F.col("title").alias("post_title"), F.lit("").alias("post_mime_type"), F.lit(None).cast("timestamp").alias("post_date"), "post_content")
    files = site.attachments.select(F.col("id").alias("ID"), F.lit("attachment").alias("post_type"), "post_status", "post_parent", F.col("title").alias("post_title"), F.col("mime").alias("post_mime_type"), F.col("created").cast("timestamp").alias("post_date"), F.lit("").alias("post_content"))
    kept = site.postmeta.where("meta_key IS NULL OR meta_key <> '_refscan_status'")
    return {"posts": posts.unionByName(files), "postmeta": kept.unionByName(meta).unionByName(results), "options": site.options, "termmeta": site.termmeta, "usermeta": site.usermeta.withColumnRenamed("meta_id", "umeta_id"), "terms": site.terms, "users": site.users.withColumnRenamed("user_id", "ID")}


#: The same numbers as DuckDB counts them.
COUNTED = {"@IDS@": "(SELECT count(*) * 3 // 2 FROM part)", "@DOCS@": "(SELECT count(*) FROM documents)"}


def prelude(*names: str, even: bool = True) -> str:
    """The views as a WITH list for DuckDB; ``names``: those wanted (attachments always)."""
    out = []
    for name in ("attachments", *(n for n in names if n != "attachments")):
        source, columns, keep = VIEWS[name]
        select = f"SELECT {', '.join(f'{with_numbers(e, COUNTED)} AS {c}' for c, e in columns.items())} FROM {source} WHERE {keep}".replace(" AS STRING)", " AS VARCHAR)")
        if name in LINKED:
            column, mark = LINKED[name]
            number = f"regexp_extract({column}, '{mark}[0-9]+')"
            rest = ", ".join(f"CASE WHEN a.stem IS NOT NULL THEN replace(v.{c}, v.number, '/u/' || a.stem) ELSE v.{c} END AS {c}" if c == column else f"v.{c}" for c in columns)
            select = f"SELECT {rest} FROM (SELECT *, {number} AS number FROM ({select})) v LEFT JOIN attachments a ON v.number = '/u/' || CAST(a.id AS VARCHAR)"
        if not even and name in UNEVEN:
            select = f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in UNEVEN[name].items())}) FROM ({select})"
        out.append(f"{name} AS ({select})")
    return "WITH " + ",\n".join(out)
