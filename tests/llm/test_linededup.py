from collections import Counter
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from refscan.llm import linededup
from tests.conftest import DATA


def want(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.sql(f"SELECT doc_id, n_lines, removed_lines, emptied, text_md5 FROM ({linededup.ORACLE})").fetchall())


def got(df):
    return sorted(tuple(r) for r in linededup.query(df).collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    assert got(docs) == want([(r.doc_id, r.text) for r in docs.collect()])


def lines(a, b):
    return [f"line number {i} with several words of its own" for i in range(a, b)]


def said(docs, **more):
    return {r.doc_id: r for r in linededup.line_dedup(docs, **more).collect()}


def test_shifted_passage_goes_and_first_stays(spark):
    shared = lines(0, 30)
    rows = [(1, "\n".join(lines(100, 107) + shared + lines(200, 203))), (2, "\n".join(lines(300, 301) + shared)), (3, "\n".join(lines(400, 412)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == want(rows)
    out = said(df)
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1]
    assert out[2].line_dedup.removed_lines == 30 and out[2].text == rows[1][1].split("\n")[0]


def test_short_passages(spark):
    """Two lines of any length, repeated in other surroundings, with blank lines between and around."""
    rows = [(i, "\n".join([f"own {i}", "", "ab", *([""] * (i % 3)), "c", f"tail {i}"])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == want(rows)
    out = said(df)
    assert out[0].text == rows[0][1] and all(out[i].text == f"own {i}\n\ntail {i}" for i in range(1, 20))
    alone = [(i, f"own {i}\nthe same line\ntail {i}") for i in range(9)]
    assert {r.text for r in said(spark.createDataFrame(alone, "doc_id long, text string")).values()} == {t for _, t in alone}


def test_all_repeated_runs_go(spark):
    """No window of two lines is left twice, and every line is left somewhere."""
    rng = np.random.default_rng(3)
    pool = [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(1, 12)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == want(rows)
    left = {i: r.text.split("\n") for i, r in said(df).items()}
    assert {x for _, t in rows for x in t.split("\n")} == {x for t in left.values() for x in t if x}
    before = Counter(p for _, t in rows for p in pairwise(t.split("\n")))
    assert max(before.values()) > 2
    kept = {(i, p) for i, t in left.items() for p in pairwise(t)}
    assert sum(p in before and before[p] > 1 for _, p in kept) <= len([p for p in before if before[p] > 1])


def test_long_line(spark):
    passage = " ".join(f"word{i}" for i in range(55))
    rows = [(1, f"a\n{passage}\nb"), (2, passage), (3, f"c d\n{passage}")]
    out = said(spark.createDataFrame(rows, "doc_id long, text string"))
    assert (out[1].text, out[2].text, out[3].text) == (rows[0][1], "", "c d")
    assert [out[i].line_dedup.emptied for i in (1, 2, 3)] == [False, True, False]


def test_odd_rows(spark):
    text = "\n".join(lines(0, 12))
    rows = [(1, None, "x"), (2, "", "x"), (3, text, "x"), (3, text, "y"), (None, text, "z"), (4, "\n\n", "z"), (5, "x\n" * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string").selectExpr("*", "1 as n_lines", "'q' as _id", "'d' as _DIGEST", "'t' as _text", "'g' as _gone")
    out = linededup.line_dedup(docs)
    assert set(out.columns) == {*docs.columns, "line_dedup"}
    by = sorted(((r.doc_id or 0, r.chunk, r.text, r.line_dedup.n_lines, r.line_dedup.removed_lines) for r in out.collect()), key=str)
    assert all((r.n_lines, r._id, r._DIGEST, r._text, r._gone) == (1, "q", "d", "t", "g") for r in out.collect())
    assert (1, "x", None, 0, 0) in by and (2, "x", "", 1, 0) in by and (4, "z", "\n\n", 3, 0) in by
    same = [r for r in by if r[0] == 3]
    assert len(same) == 2 and same[0][2:] == same[1][2:] and same[0][2] == ""
    assert [r[4] for r in by if r[0] == 0] == [0]  # a null id is the first occurrence
    assert next(r for r in by if r[0] == 5)[2:] == ("x\n", 3001, 2999)
    assert linededup.query(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="report"):
        linededup.line_dedup(docs, report="chunk")


@pytest.mark.parametrize("words", [1, 49, 50])
def test_line_of_words(spark, words):
    line = " ".join(["abcdefghij"] * words)
    rows = [(i, f"t{i}\n{line}\nu{i}") for i in range(4)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want(rows)


def test_copies_of_a_long_text(spark):
    """What a row holds follows the text: two copies of 200,000 lines."""
    n = 200_000
    text = "\n".join(f"line {i} of a long text that stands twice in the table" for i in range(n))
    rows = linededup.line_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).select("doc_id", F.length("text").alias("chars"), "line_dedup.*").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, len(text), n, 0, False), (2, 0, n, n, True)]
