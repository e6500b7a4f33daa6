"""Meta rows with two owners, as attachments and posts share ids, and repeated ones: each counts by itself, as in the SQL."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from refscan.operators import candidates
from refscan.plans import queries as registered
from tests.conftest import DATA
from tests.oracle import compared, connection


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with attachments of posts' ids, and orders that come again, some of them with another value."""
    out = tmp_path_factory.mktemp("shared-ids")
    small = {t: spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("part", "orders")}
    again = small["orders"].where("o_orderkey % 10 < 3").withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 10 < 2 THEN o_custkey ELSE o_custkey + 1 END"))
    small["part"].unionByName(small["part"].withColumn("p_partkey", F.col("p_partkey") + 1_000_049)).write.parquet(f"{out}/part.parquet")
    small["orders"].unionByName(again).unionByName(again.where("o_orderkey % 4 = 0")).write.parquet(f"{out}/orders.parquet")
    for path in Path(DATA, "sf0.001").iterdir():
        if not Path(out, path.name).exists():
            Path(out, path.name).symlink_to(path)
    return str(out)


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


def same(spark, folder, con, name):
    assert compared(registered.queries()[name](spark, folder), registered.SQL[name], con) > 0


@pytest.mark.parametrize("name", ["cand_exact", "ver_exact", "ver_csv", "ver_json_id", "cand_csv_mid", "cand_json_int", "ver_basename", "det_postmeta", "agg_ref_count"])
def test_rows_that_are_looked_up(spark, folder, con, name):
    same(spark, folder, con, name)


def test_equal_rows(spark):
    """Rows of one id: equal ones are as many pairs, others are told apart, whichever entries of theirs match."""
    ids = spark.createDataFrame([(i, str(i), 0, [f"{i}-a.jpg", "a.jpg", f"plain-name-{i}", "x"]) for i in (5, 7)], "attachment_id long, id_text string, parent_id long, basenames array<string>")
    texts = [(1, "5"), (1, "5"), (1, "5"), (1, "5,7"), (2, "7"), (2, "plain-name-5 5-a.jpg 5"), (2, "plain-name-5 5-a.jpg 5"), (2, "no")]
    rows = spark.createDataFrame(texts, "k long, v string")
    met = candidates.mentions(rows, "k", "v", ids, ["exact", "csv"], by_name=True)
    got = sorted((r.k, r.attachment_id, r.exact, r.csv, r.name, r.copies) for r in met.select("k", "attachment_id", "copies", *(candidates.has(F.col("bits"), f).alias(f) for f in ("exact", "csv", "name"))).collect())
    want = [(1, 5, False, True, False, 1), (1, 5, True, True, False, 3), (1, 7, False, True, False, 1), (2, 5, False, False, True, 2), (2, 7, False, False, True, 2), (2, 7, True, True, False, 1)]
    assert got == want
    assert sorted(map(tuple, candidates.name_pairs(rows, "k", "v", ids).collect())) == [(2, 5)] * 2 + [(2, 7)] * 2
    assert sorted(map(tuple, candidates.id_pairs(rows, "k", "v", ids).collect())) == [(1, 5), (1, 7), (2, 5), (2, 7)]
