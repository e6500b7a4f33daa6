"""What texts mention which attachments: an index of occurrences, made in one pass over each text, and equi-joins.

A text gives entries. Each run of digits gives its number with the forms it stands in: what is right before and after it, whether it is a
member of a comma list, of a gallery's list, or a leaf of a serialized value. All forms are decided there, so the text itself is
never joined with anything. Each dot before a known extension gives the text up to there, to be compared with names that have the
same last characters (an anchor). Names without an extension are found by their rarest gram, which comes with the text around it.
Equal entries of a text are one; equal rows of a table count by themselves.

Entries leave the scan only if a bitmap of all ids and anchors has them. They are joined with ids, anchors and grams; what an anchor met
is joined with whole names of the lengths that the anchor's names have. So no join grows with texts times attachments,
however many names share an ending such as ``-150x150.jpg``. What is left are pairs of row and attachment, each with its forms.
What has to be known of all names to read a text (extensions, lengths) is a subquery of one row: nothing runs while a plan is made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import BLANKS

#: Characters before the extension that are joined on; shorter names have shorter anchors.
ANCHOR = 8
EXTENSION = r"\.[A-Za-z0-9]{1,5}$"
#: Characters of a gram.
GRAM = 6
#: Bits of the bitmap of ids and anchors, and of that of grams, which each row carries if there are names without an extension.
WIDE, NARROW = 1 << 23, 1 << 16
#: Digits of an id, at the most.
DIGITS = 19


# What is around a run of digits {r}, in SQL: {b} the text up to the run before it, {a} up to the one after it; {first}, {last}: there is none; {p} the
# run before it, {e} the text before that. Expressions are texts here, as each is used for several tables: one call makes one of them.
BEFORE_MEMBER = "(btrim(substring_index({b}, ',', -1), '{blanks}') = '' AND ({first} OR contains({b}, ',')))"
AFTER_MEMBER = "(btrim(substring_index({a}, ',', 1), '{blanks}') = '' AND ({last} OR contains({a}, ',')))"
# Forms that are looked up (as in ``predicates.CANDIDATES``, and ``content``) and forms that are accepted, each by what is around a run.
FORMS = {
    "find_exact": "{first} AND {last} AND {b} = '' AND {a} = ''",
    "find_csv_start": "{first} AND {b} = '' AND startswith({a}, ',')",
    "find_csv_end": "{last} AND {a} = '' AND endswith({b}, ',')",
    "find_csv_mid": "endswith({b}, ',') AND startswith({a}, ',')",
    "find_json_int": "endswith({b}, '\"id\":')",
    "find_json_str": "endswith({b}, '\"id\":\"') AND startswith({a}, '\"')",
    "find_content": "{open} OR endswith({b}, ',') AND (startswith({a}, ',') OR startswith({a}, '\"') OR startswith({a}, ']')) OR endswith({b}, '[') AND (startswith({a}, ',') OR startswith({a}, ']'))",
    "exact": "{first} AND {last} AND btrim({b}, '{blanks}') = '' AND btrim({a}, '{blanks}') = ''",
    "csv": f"{BEFORE_MEMBER} AND {AFTER_MEMBER}",
    "ser_int": "endswith({b}, 'i:') AND startswith({a}, ';')",
    "ser_str": "{b} = ':\"' AND startswith({a}, '\"') AND {p} = CAST(length({r}) AS STRING) AND endswith({e}, 's:')",
    "json_id": "{b} RLIKE r'\"id\":\\s*\"?\\z'",
    "wp_image": "endswith({b}, 'wp-image-')",
}
#: The same where blanks at the end of a text that is looked up don't count.
PADDED = {"find_exact": "{first} AND {last} AND {b} = '' AND rtrim({a}) = ''"}
# What stands before a run that is looked up by any of its first digits.
OPEN = {"json_int": ('"id":',), "content": ("wp-image-", '"id":', 'ids="')}
# Lists of ids that are accepted whatever is around a member: a text that must be there, and how a list is found.
LISTS = {"gallery_block": ('"ids":', r'"ids":\s*\[([^\]]*)\]'), "gallery_sc": ("[gallery", r"""(?:\[gallery|(?!^)\G)[^\]]*?ids=(?=["']([^"']*)["'])""")}
#: A name in the text; an id or a name that is a leaf of the value, or in one.
OTHERS = ("name", "leaf", "leaf_name")
BIT = {form: 1 << n for n, form in enumerate((*FORMS, *LISTS, *OTHERS))}
META = ("find_exact", "find_csv_start", "find_csv_end", "find_csv_mid", "find_json_int", "find_json_str", "ser_int", "ser_str", "exact", "csv", "json_id")
CONTENT = ("find_content", "wp_image", "json_id", "gallery_block", "gallery_sc")
FOUND_META = META[:8]


def has(bits: Column, *forms: str) -> Column:
    """Whether any of the forms is among those of a pair."""
    return bits.bitwiseAND(F.lit(sum(BIT[f] for f in forms))) != 0


def around(form: str, i: str = "i", r: str = "r", padded: bool = False) -> str:
    """A form's condition on the i-th run r of a text's runs and gaps (t)."""
    ends = lambda names: "(" + " OR ".join(f"endswith({{b}}, '{x}')" for x in names) + ")"
    blanks = BLANKS.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\u000b", "\\u000B").replace("\0", "\\u0000")
    parts = {"b": f"get(t.gaps, {i})", "a": f"get(t.gaps, {i} + 1)", "first": f"({i} = 0)", "last": f"({i} = size(t.runs) - 1)", "p": f"get(t.runs, {i} - 1)", "e": f"get(t.gaps, {i} - 1)", "r": r, "blanks": blanks}
    known = FORMS | PADDED if padded else FORMS
    text = known[form].replace("{open}", ends(OPEN["content"])) if form in known else ends(OPEN[form])
    return "(" + text.format(**parts) + ")"


def once(value: str, name: str, use: str) -> str:
    """``use`` of a value, by a name, that is computed once, however often it is used."""
    return f"transform(array({value}), {name} -> {use})[0]"


RUNS = "regexp_extract_all({0}, '([0-9]+)', 1)"
NONE = "CAST(array() AS ARRAY<STRING>)"


def numbers(text: str, forms: Sequence[str], every_prefix: bool = False, padded: bool = False) -> str:
    """Entries i<forms>:<run> of a text's runs of digits, in SQL.

    A run that is looked up by its first digits also finds the ids that these are: those that are runs of the
    text themselves, as others have no accepted form, or with ``every_prefix`` all. padded: blanks at the end don't count."""
    own = [f for f in forms if f in FORMS]
    opening = next((f for f in forms if f.removeprefix("find_") in OPEN), None)
    found = []
    if own:
        bits = " + ".join(f"IF({around(f, padded=padded)}, {BIT[f]}, 0)" for f in own)
        every = f"transform(t.runs, (r, i) -> concat('i', {bits}, ':', r))"
        if opening:
            longer = f"filter(t.runs, (r, i) -> length(r) > 1 AND {around(opening.removeprefix('find_'))})"
            first = f"array_distinct(flatten(transform({longer}, r -> transform(sequence(1, least(length(r) - 1, {DIGITS})), n -> left(r, n)))))"
            every = f"concat({every}, transform({first if every_prefix else f'array_intersect({first}, t.runs)'}, r -> concat('i{BIT[opening]}:', r)))"
        found.append(once(f"named_struct('runs', {RUNS.format(text)}, 'gaps', split({text}, '[0-9]+'))", "t", every))
    for form in (f for f in forms if f in LISTS):
        mark, pattern = LISTS[form]
        quoted = pattern.replace("'", "\\x27")
        lists = f"regexp_extract_all({text}, r'{quoted}', 1)"
        found.append(f"IF(contains({text}, '{mark}'), transform(flatten(transform({lists}, x -> {RUNS.format('x')})), r -> concat('i{BIT[form]}:', r)), {NONE})")
    return f"concat({', '.join(found)})"


# Entries n<forms>:<length of the anchor>:<ending> of a text x.text: for each dot of the text, each extension after it and each size of an anchor, the text
# before the extension's end, as far as names reach. What is before a dot is read forwards in the reversed text, as a look-behind would count half characters.
ENDINGS = r"""IF(exists(_reading.extensions, e -> contains(x.text, e)), flatten(zip_with(
  transform(reverse(regexp_extract_all(reverse(x.text), concat(r'(?s)(?<=[A-Za-z0-9])\.(?=(.{0,', _reading.longest, '}))'), 1)), y -> reverse(y)),
  regexp_extract_all(x.text, r'\.(?=([A-Za-z0-9]{1,5}))', 1),
  (b, a) -> flatten(transform(filter(_reading.extensions, e -> startswith(concat('.', a), e)), e -> transform(_reading.sizes, n -> concat('n', x.bits, ':', n + length(e), ':', b, e)))))), NONE)"""
# Entries w<forms>:<window> and g<forms>:<gram>\0<text around it> of windows that names without an extension may have. Windows go on by whole characters;
# the text around one is put together from windows. No name has a zero character.
GRAMS = r"""IF(_reading.plain > 0, concat(
  transform(flatten(transform(_reading.short, n -> filter(array_distinct(regexp_extract_all(x.text, concat('(?s)(?=(.{', n, '})).'), 1)), w -> KNOWN))), w -> concat('w', x.bits, ':', w)),
  IF(_reading.plain >= GRAM, transform(array(regexp_extract_all(x.text, '(?s)(?=(.{GRAM})).', 1)), all -> transform(
    filter(transform(all, (w, i) -> named_struct('w', w, 'i', i)), h -> transform(array(h.w), w -> KNOWN)[0]),
    h -> concat('g', x.bits, ':', h.w, '\0', array_join(transform(sequence(greatest(0, h.i - _reading.plain), h.i + _reading.plain, GRAM),
      j -> CASE WHEN j < size(all) THEN get(all, j) WHEN j < size(all) + GRAM - 1 THEN right(get(all, size(all) - 1), GRAM - 1 + size(all) - j) ELSE '' END), ''))))[0], NONE)), NONE)"""


def named(texts: str) -> str:
    """Entries of names of several texts (array of bits, text), in SQL; ``_reading`` is what has to be known to read them."""
    known_ = f"getbit(get(_reading.grams, CAST(shiftright(pmod(xxhash64(w), {NARROW}), 6) AS INT)), CAST(pmod(pmod(xxhash64(w), {NARROW}), 64) AS INT)) = 1"
    both = f"concat({ENDINGS}, {GRAMS})".replace("KNOWN", known_).replace("GRAM", str(GRAM)).replace("NONE", NONE)
    return f"flatten(transform({texts}, x -> {both}))"


def a_text(text: str, form: str) -> str:
    return f"named_struct('bits', {BIT[form]}, 'text', {text})"


def slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def in_bitmap(bitmap: Column, key: Column, bits: int) -> Column:
    at = slot(key, bits)
    return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1


def bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """One row: ``bitmap``, an array of longs, with a bit set for each of the keys (column k). Parts of it are merged by their or."""
    at = slot(F.col("k"), bits)
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(pmod(xxhash64(k), {bits}), 64) AS INT))").alias("own"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("own"))
    merged = words.unionByName(every).groupBy("word").agg(F.bit_or("own").alias("own"))
    return merged.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "own"))), lambda x: x["own"]).alias("bitmap"))  # of a fixed size


def grams(text: Column, s: Column, bits: Column) -> Column:
    """Entries w<forms>:<window> and g<forms>:<gram><text around it> of windows of a text that names without an extension may have."""
    pattern = lambda n: F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))."))
    known = lambda w: in_bitmap(s["grams"], w, NARROW)
    short = F.flatten(F.transform(s["short"], lambda n: F.filter(F.array_distinct(F.regexp_extract_all(text, pattern(n), F.lit(1))), known)))

    def around(all_: Column) -> Column:
        n, end = F.size(all_), F.get(all_, F.size(all_) - 1)
        piece = lambda j: F.when(j < n, F.get(all_, j)).when(j < n + GRAM - 1, F.right(end, GRAM - 1 + n - j)).otherwise("")
        reach = s["plain"]
        near = lambda i: F.array_join(F.transform(F.sequence(F.greatest(F.lit(0), i - reach), i + reach, F.lit(GRAM)), piece), "")
        hits = F.filter(F.transform(all_, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: known(x["w"]))
        return F.transform(hits, lambda x: entry("g", bits, x["w"], F.lit("\0"), near(x["i"])))  # no name has that mark

    long = once(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1)), around)
    return F.when(s["plain"] > 0, F.concat(F.transform(short, lambda w: entry("w", bits, w)), F.when(s["plain"] >= GRAM, long).otherwise(none()))).otherwise(none())


def names(contexts: DataFrame) -> DataFrame:
    """attachment_id, name, ext ('' for none), size (characters before ext), anchor (the last of them, with ext)."""
    each = contexts.select("attachment_id", F.explode("basenames").alias("name")).where("name <> ''")
    found = each.withColumn("ext", F.regexp_extract("name", EXTENSION, 0)).withColumn("size", F.length("name") - F.length("ext"))
    found = found.withColumn("ext", F.when(F.col("size") > 0, F.col("ext")).otherwise("")).withColumn("size", F.length("name") - F.length("ext"))
    return found.withColumn("anchor", F.right("name", F.least(F.lit(ANCHOR), F.col("size")) + F.length("ext")))


def rarest(plain: DataFrame) -> DataFrame:
    """Of names (attachment_id, name): the gram that the fewest names have; shorter names are their own."""
    short = F.length("name") < GRAM
    windows = F.array_distinct(F.regexp_extract_all("name", F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1)))
    each = plain.select("attachment_id", "name", F.explode(F.when(short, F.array("name")).otherwise(windows)).alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    return each.join(counts, "gram").groupBy("attachment_id", "name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


@dataclass(frozen=True)
class Known:
    """What texts are compared with: keys (kind, k, attachment_id, lengths, name), whole names, and what has to be known to read a text."""

    keys: DataFrame
    whole: DataFrame
    reading: Column | None  # a subquery of one row; without names none is needed
    wanted: Column  # a subquery: the bitmap of ids and anchors


def known(contexts: DataFrame, ids: bool = True, by_name: bool = True) -> Known:
    each = names(contexts)
    nothing = {"attachment_id": F.lit(None).cast("long"), "lengths": F.lit(None).cast("array<int>"), "name": F.lit(None).cast("string")}
    keys = lambda df, kind, k, **own: df.select(F.lit(kind).alias("kind"), F.col(k).alias("k"), *(own.get(c, default).alias(c) for c, default in nothing.items()))
    found, reading = [], None
    if ids:
        found.append(keys(contexts, "i", "id_text", attachment_id=F.col("attachment_id")))
    if by_name:
        ended, plain = each.where("ext <> ''"), each.where("ext = ''")
        plain = rarest(plain).withColumn("kind", F.when(F.length("name") < GRAM, "w").otherwise("g"))
        found.append(keys(ended.groupBy("anchor").agg(F.collect_set(F.length("name")).alias("own")), "n", "anchor", lengths=F.col("own")))  # no more than a name is long
        found.append(plain.select("kind", F.col("gram").alias("k"), "attachment_id", F.lit(None).cast("array<int>").alias("lengths"), "name"))
        # A few numbers, extensions and a bitmap of a fixed size, however many names there are.
        no_ext = F.col("ext") == ""
        said = each.agg(
            F.array_sort(F.collect_set(F.when(~no_ext, F.col("ext")))).alias("extensions"),
            F.array_sort(F.collect_set(F.when(~no_ext, F.least(F.lit(ANCHOR), F.col("size"))))).alias("sizes"),
            F.coalesce(F.max(F.when(~no_ext, F.length("name"))), F.lit(0)).alias("longest"),
            F.coalesce(F.max(F.when(no_ext, F.length("name"))), F.lit(0)).alias("plain"),
            F.array_sort(F.collect_set(F.when(no_ext & (F.length("name") < GRAM), F.length("name")))).alias("short"),
        )
        small = bitmap(plain.select(F.col("gram").alias("k")), NARROW)
        reading = said.crossJoin(F.broadcast(small)).select(F.struct("extensions", "sizes", "longest", "plain", "short", F.when(F.col("plain") > 0, F.col("bitmap")).otherwise(F.array().cast("array<long>")).alias("grams")).alias("reading")).scalar()  # of one row each
    every = reduce(DataFrame.unionByName, found)
    wanted = bitmap(every.where(F.col("kind").isin("i", "n")).select(F.concat("kind", "k").alias("k")), WIDE).scalar()
    return Known(every, each.where("ext <> ''").select("name", "attachment_id"), reading, wanted)


def entries(rows: DataFrame, columns: Sequence[str], ids: str | None, texts: str | None, about: Known) -> DataFrame:
    """The columns, _text, place, kind, k, rest, bits: a row for each different entry of a row of a table that may match, by its place.

    ids: an array of entries of ids; texts: an array of the texts that may hold names (``a_text``); both in SQL.
    _text: of the row's text, so that rows of one id with other texts are told apart."""
    source = rows if texts is None else rows.withColumn("_reading", about.reading)
    found = [*([ids] if ids else []), *([named(texts)] if texts else [])]
    each = source.select(*columns, F.xxhash64("text").alias("_text"), F.posexplode(F.expr(f"array_distinct(concat({', '.join(found)}))")).alias("place", "x"))
    each = each.selectExpr(
        *columns, "_text", "place", "left(x, 1) AS kind", "substring_index(substring(x, 2, 12), ':', 1) AS _forms", "substring(x, length(_forms) + 3) AS _tail",
        "IF(kind = 'n', substring_index(_tail, ':', 1), '') AS _size", "IF(kind = 'n', substring(_tail, length(_size) + 2), _tail) AS _body",
        f"CASE kind WHEN 'n' THEN right(_body, try_cast(_size AS INT)) WHEN 'g' THEN left(_body, {GRAM}) ELSE _body END AS k", "IF(kind IN ('n', 'g'), _body, NULL) AS rest", "CAST(_forms AS INT) AS bits",
    ).select(*columns, "_text", "place", "kind", "k", "rest", "bits")
    return each.where(F.col("kind").isin("w", "g") | in_bitmap(about.wanted, F.concat("kind", "k"), WIDE))


def matched(found: DataFrame, columns: Sequence[str], about: Known, by_name: bool = True) -> DataFrame:
    """The columns, attachment_id, bits, copies: each pair of a row and an attachment that it mentions, with all its forms.

    copies: how many rows are equal in the columns and the text, as those of a meta row with several owners. Each has
    the same entries, so that any one of them that is met is met as often as there are rows."""
    of_row = [*columns, "_text"]
    hits = found.join(about.keys, ["kind", "k"]).where((F.col("kind") != "g") | F.contains("rest", F.col("name")))
    hits = hits.select(*of_row, "place", "bits", "rest", "attachment_id", "lengths", F.col("name").alias("plain"))
    if by_name:
        # One row for each ending that a name may be. What is found already gets a name that there is not, another one in each row.
        each = hits.select(*of_row, "place", "bits", "rest", "plain", F.col("attachment_id").alias("found"), F.explode(F.coalesce("lengths", F.array(F.lit(0)))).alias("n"))
        name = F.when(F.col("found").isNull(), F.right("rest", F.col("n"))).otherwise(F.concat(F.lit("\0"), F.xxhash64(*columns).cast("string")))
        hits = each.withColumn("name", name).drop("rest").join(about.whole, "name", "left").withColumn("attachment_id", F.coalesce("found", "attachment_id")).where("attachment_id IS NOT NULL")
    pair = [*of_row, "attachment_id"]
    met = hits.repartition(*pair).groupBy(*pair, "place", *(["n", "plain"] if by_name else [])).agg(F.max("bits").alias("bits"), F.count("*").alias("copies"))
    return met.groupBy(*pair).agg(F.bit_or("bits").alias("bits"), F.max("copies").cast("int").alias("copies")).drop("_text")


def repeated(pairs: DataFrame) -> DataFrame:
    """Pairs that are ``matched``, each one as often as there are equal rows of it."""
    return pairs.withColumn("copies", F.explode(F.array_repeat("copies", F.col("copies")))).drop("copies")


def mentions(rows: DataFrame, key: str, text: str, contexts: DataFrame, forms: Sequence[str] = (), by_name: bool = False, every_prefix: bool = False, padded: bool = False) -> DataFrame:
    """key, attachment_id, bits, copies (see ``matched``) of a table's texts: by id in any of the forms, and by name if ``by_name``."""
    about = known(contexts, bool(forms), by_name)
    own = rows.select(F.col(key).alias("row"), F.col(text).alias("text"))
    ids = numbers("text", forms, every_prefix, padded) if forms else None
    texts = f"array({a_text('text', 'name')})" if by_name else None
    return matched(entries(own, ["row"], ids, texts, about), ["row"], about, by_name).withColumnRenamed("row", key)


def id_pairs(rows: DataFrame, key: str, text: str, contexts: DataFrame) -> DataFrame:
    """Distinct (key, attachment_id): the id is a run of digits of the text."""
    return mentions(rows, key, text, contexts, ["exact"]).select(key, "attachment_id").distinct()


def name_pairs(rows: DataFrame, key: str, text: str, contexts: DataFrame) -> DataFrame:
    """(key, attachment_id) for each row whose text holds a name of the attachment."""
    return repeated(mentions(rows, key, text, contexts, by_name=True)).select(key, "attachment_id")
