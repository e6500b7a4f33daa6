import os

import pyarrow as pa
import pytest

from refscan.llm import common


class Session:
    def __init__(self, **conf):
        self.conf = conf


def test_shared_folder(spark):
    assert common.shared_dir(Session(**{"spark.checkpoint.dir": "/x"})) == "/x"
    assert os.path.isdir(common.shared_dir(Session(**{"spark.master": "local[4]"})))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(**{"spark.master": "spark://host:7077"}))


def test_temporary_tables_go(spark):
    with common.temporary(spark):
        inner = common.written(spark.range(3), "a")
        outer = common.written(inner.where("id > 0"), "b", outside=True)
        gone = inner.inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert os.path.exists(gone)
    assert not os.path.exists(gone) and outer.count() == 2
    kept = outer.inputFiles()[0].removeprefix("file:").removeprefix("//")
    common.dropped(outer)
    assert not os.path.exists(kept)


def test_parts_of_texts():
    texts = pa.array(["a" * n for n in (5, 5, 5, 100, 1, 1)])
    assert list(common.cuts(texts, 500, 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(common.cuts(texts, 2, 10**6)) == [(0, 2), (2, 4), (4, 6)]
    assert [len(x) for x in common.texts_of(texts, 4, 10**6)] == [4, 2] and list(common.cuts(pa.array([], pa.string()), 5, 5)) == []


def test_names_and_samples(spark):
    df = spark.createDataFrame([(1, 2)], "_id int, __ID int")
    assert common.fresh(df, "id", "x", "id") == ["___id", "_x", "____id"]
    rows = spark.range(20_000)
    assert 100 < rows.where(common.sampled(0.01, "id")).count() < 300 and rows.where(common.sampled(7.0, "id")).count() == 20_000
    assert rows.where(common.sampled(1e-12, "id")).count() == 0
