"""The queries' SQL for DuckDB: plain loops over all pairs, independent of the joins that the plans use."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.fixtures import NOW, prelude

BLANKS = "' ' || chr(10) || chr(13) || chr(9) || chr(11)"
CAND = {
    "exact": "v = i",
    "csv_start": "starts_with(v, i || ',')",
    "csv_end": "ends_with(v, ',' || i)",
    "csv_mid": "contains(v, ',' || i || ',')",
    "ser_int": "contains(v, 'i:' || i || ';')",
    "ser_str": "contains(v, 's:' || length(i) || ':\"' || i || '\"')",
    "json_int": "contains(v, '\"id\":' || i)",
    "json_str": "contains(v, '\"id\":\"' || i || '\"')",
}
CONTENT = "(contains(v, 'wp-image-' || i) OR contains(v, '\"id\":' || i) OR contains(v, 'ids=\"' || i) OR contains(v, ',' || i || ',') OR contains(v, ',' || i || '\"') OR contains(v, '[' || i || ',') OR contains(v, ',' || i || ']') OR contains(v, '[' || i || ']'))"
VER = {
    "exact": f"trim(v, {BLANKS}) = i",
    "csv": f"list_contains(list_transform(string_split(v, ','), lambda x: trim(x, {BLANKS})), i)",
    "ser_int": CAND["ser_int"],
    "ser_str": CAND["ser_str"],
    "json_id": "(contains(v, '\"id\":') AND regexp_matches(v, '\"id\":\\s*\"?' || i || '([^0-9]|$)'))",
    "wp_image": "(contains(v, 'wp-image-' || i) AND regexp_matches(v, 'wp-image-' || i || '([^0-9]|$)'))",
    "gallery_block": "(contains(v, '\"ids\":') AND contains(v, i) AND regexp_matches(v, '\"ids\":\\s*\\[([^\\]]*[^0-9\\]])?' || i || '([^0-9\\]][^\\]]*)?\\]'))",
    "gallery_sc": "(contains(v, '[gallery') AND contains(v, i) AND regexp_matches(v, '\\[gallery[^\\]]*ids=[\"'']([^\"'']*[^0-9\"''])?' || i || '([^0-9\"''][^\"'']*)?[\"'']'))",
}
ANY_ID = "(" + " OR ".join(CAND.values()) + ")"
ANY_ID_PADDED = "(" + " OR ".join({**CAND, "exact": "rtrim(v, ' ') = i"}.values()) + ")"
NAMED = "(contains(v, stem) AND len(list_filter(basenames, lambda b: contains(v, b))) > 0)"

CTX = """ctx AS (
  SELECT id AS attachment_id, CAST(id AS VARCHAR) AS i, post_parent AS parent_id, stem, list_distinct_kept AS basenames FROM (
    SELECT *, list_filter(names, lambda x, k: list_position(names, x) = k AND x NOT IN ('', '0')) AS list_distinct_kept FROM (
      SELECT *, [base, coalesce(original_image, ''), size_thumb, regexp_replace(base, '-(scaled|rotated|[0-9]+x[0-9]+)(\\.[a-z0-9]+)$', '\\2', 'i')] AS names FROM (
        SELECT *, regexp_extract(attached_file, '[^/]*$') AS base FROM attachments))))"""
OWNERS = "owners AS (SELECT id, post_type, post_status FROM posts UNION ALL SELECT id, 'attachment', post_status FROM attachments)"


def source_views(equal: Callable[[str], str] = str, like: Callable[[str], str] = str) -> dict[str, str]:
    """What is read of the text tables; equal, like: how texts are compared with words and searched for parts."""
    return {
        "content": f"content AS (SELECT id, post_status, post_content FROM posts WHERE {equal('post_type')} NOT IN ('attachment', 'revision', 'nav_menu_item') AND {equal('post_status')} <> 'auto-draft')",
        "pm": f"pm AS (SELECT meta_id, post_id, meta_key, meta_value, o.post_status FROM postmeta m JOIN owners o ON m.post_id = o.id WHERE {equal('o.post_type')} <> 'revision' AND NOT starts_with({like('meta_key')}, '_refscan_') AND {equal('meta_key')} NOT IN ('_wp_attached_file', '_wp_attachment_metadata', '_wp_attachment_image_alt', '_wp_old_slug', '_wp_old_date', '_edit_lock', '_edit_last'))",
        "op": f"op AS (SELECT option_id, option_name, option_value FROM options WHERE NOT starts_with({like('option_name')}, '_transient_') AND NOT starts_with({like('option_name')}, '_site_transient_') AND {equal('option_name')} NOT IN ('cron', 'refscan_scan_state', 'refscan_last_scan', 'refscan_changed_at', 'rewrite_rules', 'wp_user_roles', 'active_plugins', 'recently_edited', 'uninstall_plugins'))",
        "um": f"um AS (SELECT meta_id, user_id, meta_key, meta_value FROM usermeta WHERE {equal('meta_key')} <> 'session_tokens' AND NOT ends_with({like('meta_key')}, 'capabilities') AND NOT ends_with({like('meta_key')}, 'user_level') AND NOT contains({like('meta_key')}, 'user-settings'))",
    }


SOURCES = source_views()
#: How texts are compared with words, and searched for parts, by collation.
COLLATED = {"bytes": (str, str), "case": ("lower({})".format, "lower({})".format), "pad": ("rtrim({}, ' ')".format, str), "both": ("lower(rtrim({}, ' '))".format, "lower({})".format)}
NEEDS = {"content": ("posts",), "pm": ("posts", "postmeta"), "op": ("options",), "um": ("usermeta",)}

PLAIN = f"CASE WHEN {VER['exact']} THEN 'exact' WHEN {VER['csv']} THEN 'comma-list' WHEN {VER['ser_str']} OR {VER['ser_int']} THEN 'serialized' WHEN {VER['json_id']} THEN 'block-id' END"
# In the derived options the leaf is the last int of the one-entry array, and a key is followed by an s.
INSIDE = "(contains(v, ';i:' || i || ';}') OR (NOT starts_with(v, 'a:') AND (v = i OR " + NAMED + ")))"


def field(owner: str, table: str) -> str:
    return f"(NOT starts_with(meta_key, '_') AND starts_with(coalesce((SELECT min_by(s.meta_value, s.meta_id) FROM {table} s WHERE s.{owner} = r.{owner} AND s.meta_key = '_' || r.meta_key), ''), 'field_'))"


def meta_refs(detector: str, kind: str, owner: str, rows: str, table: str) -> str:
    return f"""SELECT attachment_id, '{detector}' AS detector, '{kind}' AS object_type, {owner} AS object_id, coalesce(meta_key, '') AS detail, CASE WHEN plain = 'url' THEN 'url' WHEN field THEN 'acf' ELSE plain END AS match, CASE WHEN plain = 'url' OR field THEN 'confirmed' ELSE 'possible' END AS confidence
    FROM (SELECT *, {field(owner, table)} AS field FROM (SELECT *, CASE WHEN {NAMED} THEN 'url' ELSE {PLAIN} END AS plain FROM (SELECT *, meta_value AS v FROM {rows}) t JOIN ctx ON {ANY_ID} OR {NAMED}) r WHERE plain IS NOT NULL) x"""


DETECT = {
    "content": f"""SELECT attachment_id, 'content' AS detector, 'post' AS object_type, id AS object_id, match AS detail, match, CASE WHEN post_status = 'trash' THEN 'possible' ELSE 'confirmed' END AS confidence
    FROM (SELECT *, CASE WHEN {NAMED} THEN 'url' WHEN {VER['wp_image']} THEN 'wp-image-class' WHEN {VER['json_id']} THEN 'block-id' WHEN {VER['gallery_block']} OR {VER['gallery_sc']} THEN 'gallery' END AS match
      FROM (SELECT *, post_content AS v FROM content) t JOIN ctx ON t.id <> ctx.attachment_id AND ({CONTENT} OR {NAMED})) x WHERE match IS NOT NULL""",
    "postmeta": f"""SELECT attachment_id, 'postmeta' AS detector, 'post' AS object_type, post_id AS object_id, meta_key AS detail, match, CASE WHEN post_status <> 'trash' AND match IN ('thumbnail', 'woo-gallery', 'elementor', 'url', 'acf') THEN 'confirmed' ELSE 'possible' END AS confidence
    FROM (SELECT *, CASE WHEN special = 'none' THEN NULL WHEN special IS NOT NULL THEN special WHEN plain IS NOT NULL AND {field('post_id', 'postmeta')} THEN 'acf' ELSE plain END AS match
      FROM (SELECT *, {PLAIN} AS plain, CASE WHEN meta_key = '_thumbnail_id' AND {VER['exact']} THEN 'thumbnail' WHEN meta_key = '_product_image_gallery' AND {VER['csv']} THEN 'woo-gallery' WHEN meta_key = '_elementor_data' AND ({VER['json_id']} OR {NAMED}) THEN 'elementor' WHEN meta_key = '_elementor_data' THEN 'none' WHEN {NAMED} THEN 'url' END AS special
        FROM (SELECT *, meta_value AS v FROM pm) t JOIN ctx ON t.post_id <> ctx.attachment_id AND ({ANY_ID} OR {NAMED})) r) x WHERE match IS NOT NULL""",
    "options": f"""SELECT attachment_id, 'options' AS detector, CASE WHEN match = 'theme-mod' THEN 'theme_mod' ELSE 'option' END AS object_type, CAST(0 AS BIGINT) AS object_id, option_name AS detail, match, confidence
    FROM (SELECT *, string_split(graded, ' ')[1] AS match, string_split(graded, ' ')[2] AS confidence FROM (SELECT *, CASE
        WHEN option_name IN ('site_icon', 'site_logo') AND {VER['exact']} THEN 'site-option confirmed'
        WHEN starts_with(option_name, 'theme_mods_') THEN CASE WHEN {INSIDE} THEN 'theme-mod confirmed' END
        WHEN starts_with(option_name, 'widget_') THEN CASE WHEN {INSIDE} THEN 'widget confirmed' WHEN {VER['ser_int']} THEN 'widget possible' END
        WHEN {NAMED} THEN 'url confirmed' WHEN starts_with(v, 'a:') THEN CASE WHEN {INSIDE} THEN 'serialized possible' END
        WHEN {VER['exact']} OR {VER['json_id']} THEN 'exact possible' END AS graded
      FROM (SELECT *, option_value AS v FROM op) t JOIN ctx ON {ANY_ID} OR {NAMED}) y) x WHERE match IS NOT NULL""",
    "termmeta": meta_refs("termmeta", "term", "term_id", "termmeta", "termmeta"),
    "usermeta": meta_refs("usermeta", "user", "user_id", "um", "usermeta"),
    "attached": "SELECT attachment_id, 'attached' AS detector, 'post' AS object_type, parent_id AS object_id, 'post_parent' AS detail, 'attached' AS match, 'info' AS confidence FROM ctx JOIN owners o ON ctx.parent_id = o.id WHERE parent_id > 0 AND o.post_type <> 'revision'",
}
USES = {"content": ("content",), "postmeta": ("pm",), "options": ("op",), "termmeta": (), "usermeta": ("um",), "attached": ()}
ORDER = ("postmeta", "content", "options", "termmeta", "usermeta", "attached")


def with_views(select: str, *views: str, sources: tuple[str, ...] = (), context: bool = False, owners: bool = False, collation: str | None = None) -> str:
    """The views that a query needs; collation: those of the uneven site, read under it."""
    needed = [*dict.fromkeys((*views, *(v for s in sources for v in NEEDS[s]), *(("posts",) if owners else ())))]
    own = SOURCES if collation is None else source_views(*COLLATED[collation])
    parts = [prelude(*needed, even=collation is None), *([OWNERS] if owners or "pm" in sources else []), *([CTX] if context else []), *(own[s] for s in sources)]
    return ",\n".join(parts) + "\n" + select


def refs_view() -> str:
    return "refs AS (" + " UNION ALL ".join(f"SELECT *, {n} AS ord FROM ({DETECT[d]})" for n, d in enumerate(ORDER)) + ")"


def over_refs(select: str, *views: str) -> str:
    base = with_views("", *views, "termmeta", "usermeta", sources=("pm", "content", "op", "um"), context=True, owners=True)
    return base.rstrip() + ",\n" + refs_view() + "\n" + select


LABEL = """CASE match WHEN 'acf' THEN 'ACF field' WHEN 'thumbnail' THEN 'Featured image' WHEN 'woo-gallery' THEN 'Product gallery' WHEN 'elementor' THEN 'Elementor content' WHEN 'block-id' THEN 'Block attribute'
  WHEN 'wp-image-class' THEN 'Image in content' WHEN 'gallery' THEN 'Gallery' WHEN 'url' THEN 'File URL' WHEN 'widget' THEN 'Widget' WHEN 'theme-mod' THEN 'Customizer setting' WHEN 'site-option' THEN 'Site setting'
  WHEN 'serialized' THEN 'Stored data' WHEN 'comma-list' THEN 'ID list' WHEN 'attached' THEN 'Uploaded to' ELSE 'ID value' END"""
UNUSED = "SELECT a.id AS attachment_id, a.post_status, r.scanned_at FROM attachments a JOIN results r ON a.id = r.attachment_id WHERE r.status = 'unused'"
VERDICTS = f"""SELECT c.attachment_id, CASE WHEN coalesce(bool_or(confidence <> 'info'), false) THEN 'used' ELSE 'unused' END AS status, count(r.attachment_id) AS ref_count, CAST({NOW} AS BIGINT) AS scanned_at
FROM ctx c LEFT JOIN refs r ON c.attachment_id = r.attachment_id GROUP BY c.attachment_id"""


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def in_units(b: str) -> str:
    """A size in whole units, halves up."""
    unit = lambda n, name: f"{thousands(f'floor({b} / {1 << 10 * n}.0 + 0.5)')} || ' {name}'"
    return f"CASE WHEN {b} = 0 THEN '0 B' WHEN {b} < 1024 THEN {thousands(b)} || ' B' WHEN {b} < 1048576 THEN {unit(1, 'KB')} WHEN {b} < 1073741824 THEN {unit(2, 'MB')} ELSE {unit(3, 'GB')} END"


def difference(a: str, b: str) -> str:
    """The time between two epoch seconds, in words."""
    d = f"abs({a} - ({b}))"
    said = lambda size, name: f"(SELECT n || ' {name}' || CASE WHEN n = 1 THEN '' ELSE 's' END FROM (SELECT greatest(1, CAST(floor({d} / {size}.0 + 0.5) AS BIGINT)) AS n))"
    return f"CASE WHEN {d} < 60 THEN {said(1, 'second')} WHEN {d} < 3600 THEN {said(60, 'minute')} WHEN {d} < 86400 THEN {said(3600, 'hour')} WHEN {d} < 604800 THEN {said(86400, 'day')} WHEN {d} < 2592000 THEN {said(604800, 'week')} WHEN {d} < 31536000 THEN {said(2592000, 'month')} ELSE {said(31536000, 'year')} END"
