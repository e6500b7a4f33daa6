"""Line dedup with content-defined chunks of lines.

Each line that isn't blank has a hash, and a rolling hash over each such line and the next gives every window of
two lines a value that depends on those lines alone. Chunk boundaries are where that value stops to recur in
the corpus: a chunk is a longest run of lines whose windows all occur again. So an inserted or
dropped line moves only the boundaries next to it, a shifted passage is found whole wherever it stands, and every
chunk has two lines at the least. A line of ``long_words`` words or more is a passage by itself, however it was
wrapped: it is a window of its own. Windows are compared byte by byte with the first occurrence, by doc_id and
then position, and all but that one are removed. What is removed thus stays somewhere: each removed line also stands
in an earlier window.

A window may occur in a third of all documents. Occurrences of such windows (HOT of all at the most, so they can be
broadcast) are dealt to parts by a hash of their document: minima and comparisons are made within parts, and minima then
between the parts' results.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, salts, temporary, written

KEY = ["id", "none", "digest"]
#: Windows that occur in over one in HOT of all places (and LEAST times) are dealt to parts: there are fewer than HOT of them.
HOT, LEAST = 10_000, 1_000
#: Words that make a single line a passage.
LONG_WORDS = 50


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(lines: Column, long_words: int) -> Column:
    """Array of (first, last, hash): each two lines that follow each other but for blank ones, and each long line."""
    each = F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), F.xxhash64(x).alias("h"), x.rlike(r"\S").alias("some"), (F.size(F.split(x, " ")) >= long_words).alias("long")))
    some = F.filter(each, lambda x: x["some"])
    window = lambda a, b, h: F.struct(a["i"].alias("first"), b["i"].alias("last"), h.alias("hash"))

    def of(found: Column) -> Column:
        pairs = F.zip_with(F.slice(found, F.lit(1), F.size(found) - 1), F.slice(found, F.lit(2), F.size(found) - 1), lambda a, b: window(a, b, F.xxhash64(a["h"], b["h"])))
        single = F.transform(F.filter(found, lambda x: x["long"]), lambda x: window(x, x, F.xxhash64(x["h"])))
        return F.when(F.size(found) > 1, F.concat(pairs, single)).otherwise(single)

    return F.transform(F.array(some), of)[0]


def window_text(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.filter(F.slice(lines, first, last - first + 1), lambda x: x.rlike(r"\S")), "\n")


def repeats(docs: DataFrame, long_words: int) -> DataFrame:
    """KEY, gone: for each text with repeated windows, the numbers (from 1) of the lines to remove. ``docs``: KEY, text.

    Windows are found by hash, without their text; then those of one hash and its first occurrence are compared."""
    spark = docs.sparkSession
    parts = salts(spark)
    place = F.struct((~F.col("none")).alias("some"), "id", "digest", "first")  # null ids first
    every_part = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))).alias("part")
    with temporary(spark):
        every = written(docs.select(*KEY, F.explode(windows(lines_of(F.col("text")), long_words)).alias("x")).select(*KEY, "x.*"), "windows")
        counts = every.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
        again = written(counts.select("hash", (F.col("n") > max(LEAST, every.count() // HOT)).alias("hot")), "repeated-hashes")
        hot = F.broadcast(again.where("hot"))  # fewer than HOT rows
        dealt = every.join(hot, "hash", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "digest"), F.lit(parts))).otherwise(0).cast("int")).drop("hot")
        first_of_part = F.min(place).over(Window.partitionBy("hash", "part"))
        met = written(dealt.join(again.select("hash", "hot", every_part).hint("merge"), ["hash", "part"]).withColumn("stays", first_of_part), "repeated-windows")
        hot_first = F.broadcast(met.where("hot").groupBy("hash").agg(F.min("stays").alias("first_of_all")))  # fewer than HOT rows
        # The joins of texts are merge joins at every size: what they join grows with the texts.
        marked = met.join(hot_first, "hash", "left").select(*KEY, "first", "last", "hash", "hot", "part", (place == F.coalesce("first_of_all", "stays")).alias("stays"))
        # of one text: no more than it has windows
        places = written(marked.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last", "hash", "hot", "part", "stays")).alias("places")), "places")
        # Each window is cut out of its text's lines before it becomes a row: a row holds one window, not all lines. The lines are split once.
        cut = lambda lines: F.transform("places", lambda p: p.withField("window", window_text(lines, p["first"], p["last"])))
        cut_out = docs.join(places.hint("merge"), KEY).select(*KEY, F.transform(F.array(lines_of(F.col("text"))), cut)[0].alias("places"))
        found = written(cut_out.select(*KEY, F.explode("places").alias("x")).select(*KEY, "x.*"), "repeated")
        first_text = found.where("stays").dropDuplicates(["hash"]).select("hash", F.col("window").alias("first_window"), every_part)
        same = found.where("NOT stays").join(first_text.hint("merge"), ["hash", "part"]).where(F.col("window") == F.col("first_window"))
        gone = same.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
        numbers = F.array_distinct(F.flatten(F.transform("ranges", lambda x: F.sequence(x["first"], x["last"]))))
        return written(gone.select(*KEY, numbers.alias("gone")), "gone-lines", outside=True)


def line_dedup(docs: DataFrame, long_words: int = LONG_WORDS, report: str = "line_dedup") -> DataFrame:
    """All columns and rows of ``docs``, with text without repeated chunks, and a struct column ``report``: n_lines, removed_lines, emptied.

    A chunk is a run of lines that aren't blank, with two or more lines, or one of ``long_words`` words, whose windows
    all occur earlier; blank lines between its lines go with it. Shorter repeats (single short lines) stay. Null
    texts stay null (no line); empty ones have one empty line; ``emptied`` texts have nothing but blank lines
    left; nulls in doc_id come first in the order of occurrences; rows with the same doc_id and text are one document and
    all stay or lose the same lines. Very long texts are taken whole. An empty table gives an empty result. Other
    columns stay, whatever their names; if one is named like ``report``, it is an error: choose another name."""
    if report.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {report} already: give report another name")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    key = [F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.xxhash64(F.coalesce(text, F.lit("")))]
    gone = repeats(docs.select(*(c.alias(n) for c, n in zip(key, KEY, strict=True)), "text"), long_words)
    *own, numbers, lines, rest = fresh(docs, *KEY, "gone", "lines", "rest")
    named = gone.select(*(F.col(a).alias(b) for a, b in zip([*KEY, "gone"], [*own, numbers], strict=True)))
    joined = docs.withColumns(dict(zip(own, key, strict=True))).join(named.hint("merge"), own, "left").withColumn(lines, F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(1), F.size(lines)), numbers)  # line numbers differ, so none is lost
    cut = joined.withColumn(rest, F.when(F.col(numbers).isNotNull(), F.transform(left, lambda i: F.element_at(lines, i))))
    changed, n, kept = F.col(rest).isNotNull(), F.size(lines).cast("long"), F.size(rest).cast("long")
    said = F.struct(F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(changed, n - kept).otherwise(0).cast("long").alias("removed_lines"), (changed & ~F.coalesce(F.exists(rest, lambda x: x.rlike(r"\S")), F.lit(False))).alias("emptied"))
    return cut.withColumn(report, said).withColumn("text", F.when(changed, F.array_join(rest, "\n")).otherwise(F.col("text"))).drop(*own, numbers, lines, rest)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, removed_lines, emptied, text_md5 of what is left."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "line_dedup.n_lines", "line_dedup.removed_lines", "line_dedup.emptied", F.md5("text").alias("text_md5"))


#: The same in DuckDB, by the lines themselves instead of their hashes.
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), following AS (
  SELECT doc_id, i AS first, line, lead(i) OVER w AS last, lead(line) OVER w AS next FROM lines WHERE regexp_matches(line, '\\S') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), chunks AS (
  SELECT doc_id, first, last, line || chr(10) || next AS chunk FROM following WHERE last IS NOT NULL
  UNION ALL SELECT doc_id, first, first, line FROM following WHERE len(string_split(line, ' ')) >= 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) AS nth FROM chunks) WHERE nth > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS rest,
    count(g.i) > 0 AND coalesce(bool_and(NOT regexp_matches(l.line, '\\S')) FILTER (g.i IS NULL), true) AS emptied
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS BIGINT) AS n_lines, CAST(removed AS BIGINT) AS removed_lines, emptied, CASE WHEN d.text IS NULL THEN NULL ELSE md5(rest) END AS text_md5
FROM documents d JOIN kept k ON d.doc_id = k.doc_id
"""
