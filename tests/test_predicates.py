import pytest
from pyspark.sql import functions as F

from refscan.functions.predicates import CANDIDATES, VERIFIERS, content_candidate, has_basename, id_candidate

ID = "123"
VECTORS = {
    "exact": (["123", " 123 ", "123\n"], ["1234", "9123", "4,123,9", ""]),
    "csv": (["123,4", "4,123,9", "4,123", "123", "4, 123 ,9"], ["4,1234,9", "4,91230,9"]),
    "ser_int": (["a:1:{i:0;i:123;}", "i:123;"], ["i:1234;", "i:123", "i:9123;"]),
    "ser_str": (['s:3:"123";'], ['s:4:"1234";', 's:4:"9123";', 's:6:"123456";']),
    "json_id": (['{"id":123}', '{"id": 123,', '{"id":"123"}', '{"id":123.5}', '{"id":"123abc"}'], ['{"id":1234}', '{"media_id":123}', '{"ids":[123]}']),
    "wp_image": (['<img class="wp-image-123">', "wp-image-123"], ["wp-image-1234", "wp-image-9123"]),
    "gallery_block": (['"ids":[4,123,9]', '"ids": [123]', '"ids":[4, 123, 9]', '"ids":["123"]'], ['"ids":[1234]', '"ids":[4,9123]', '"ids":[4],123]']),
    "gallery_sc": (['[gallery ids="4,123,9"]', "[gallery columns='2' ids='123']"], ['[gallery ids="1234"]', '[gallery include="4,123,9"]', "ids='123'"]),
}


def holds(spark, predicate, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, v string")
    return [r.hit for r in df.select("n", predicate(F.col("v"), F.lit(ID)).alias("hit")).orderBy("n").collect()]


@pytest.mark.parametrize("name", VECTORS)
def test_verifier(spark, name):
    good, bad = VECTORS[name]
    assert holds(spark, VERIFIERS[name], good + bad) == [True] * len(good) + [False] * len(bad)


def test_candidates_are_literal(spark):
    assert holds(spark, CANDIDATES["json_int"], ['"id":1234', '"id": 123']) == [True, False]
    assert holds(spark, CANDIDATES["csv_mid"], ["%,123,_", ",1_3,"]) == [True, False]
    assert holds(spark, CANDIDATES["csv_start"], ["123,", ",123"]) == [True, False]
    assert holds(spark, id_candidate, [" 123", "123\n", "4, 123 ,9", "123 ,9", '["123"]', "0123"]) == [False] * 6
    assert holds(spark, content_candidate, ['"id":"123"', '"ids":[4, 123, 9]', "[gallery ids='123,9']", "[gallery ids='4,123,9']"]) == [False, False, False, True]


def test_basename_has_no_boundary(spark):
    df = spark.createDataFrame([("superhero.jpg", ["hero.jpg"]), ("other.jpg", ["hero.jpg"]), ("x", [""]), ("x", [])], "v string, names array<string>")
    assert [r.hit for r in df.select(has_basename(F.col("v"), F.col("names")).alias("hit")).collect()] == [True, False, False, False]
