import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from refscan.llm import merkle
from tests.conftest import DATA
from tests.oracle import compared, connection


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """The root, and each leaf's siblings as (left, right) by level."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for n, i in enumerate(at):
            run = runs[i // 3]
            proofs[n].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at, level = [i // 3 for i in at], [sha("".join(r)) for r in runs]
    return level[0], proofs


def expected(rows):
    """The query's rows; rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[s] = tree([leaf(r) for r in by[s]])
    root, tops = tree([own[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, proof in zip(by[s], own[s][1], strict=True):
            way = proof + top
            got = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                got = (*r[:4], r[4].replace("\n", ""))
            fold = leaf(got)
            for a, b in way:
                fold = sha(a + fold + b)
            out.append((r[0], leaf(r), own[s][0], root, sha("".join(a + b for a, b in way)), fold, fold == root))
    return sorted(out, key=repr)


def test_query_on_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = expected([tuple(r) for r in docs.select(*merkle.FIELDS).collect()])
    assert sorted(map(tuple, merkle.query(docs).collect()), key=repr) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, size):
    assert compared(merkle.query(spark.read.parquet(f"{DATA}/{size}/documents.parquet")), merkle.ORACLE, connection(f"{DATA}/{size}")) > 0


def test_hot_source_over_many_parts(spark):
    """One source has most rows, of many small parts: frontiers need several rounds."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.8 else f"s{rng.randrange(40)}", None, i, f"line {i}\nmore") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(map(tuple, merkle.query(df).collect()), key=repr) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "en", 0, ""), (1, "", "en", 0, ""), (1, "", "en", 0, ""), (2, "é", "x", 5, "a\nb\n"), (2, "z", None, 5, "a\nb\n"), (3, "z", "", None, "long\n" * 200_000), (-4, "z", "", 1, "\x00ü")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, level int, tree string")
    assert sorted(map(tuple, merkle.query(df).collect()), key=repr) == expected(rows)
    assert merkle.query(df.limit(0)).count() == 0
    one = merkle.query(df.where("doc_id = -4")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf(rows[-1]) and one.proof_sha256 == sha("") and one.verified
    found = merkle.manifest(df, carried=["level"]).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(found) == len(rows) and all(r.again == r.root and r.level == 1 for r in found)
