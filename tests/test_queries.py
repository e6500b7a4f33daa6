"""Every registered query of the site against its SQL."""

import pytest

from refscan.plans import queries as registered
from tests.conftest import DATA
from tests.oracle import compared, connection


@pytest.fixture(scope="module")
def con():
    return connection(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, con, name):
    compared(registered.queries()[name](spark, f"{DATA}/sf0.001"), registered.SQL[name], con)


@pytest.mark.parametrize("name", ["fn_size", "fn_time", "fn_evidence", "qry_unused_table", "qry_scan_card", "qry_check", "det_postmeta", "det_content", "cand_json_str", "cand_basename", "st_advance"])
def test_larger_tables(spark, name):
    rows = compared(registered.queries()[name](spark, f"{DATA}/sf0.01"), registered.SQL[name], connection(f"{DATA}/sf0.01"))
    assert rows > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == spark.read.parquet(f"{DATA}/sf0.001/part.parquet").count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
