"""Runs a query and its SQL on the same tables and compares schema, rows and values."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compared(df, sql, con):
    want = con.execute(sql)
    names, expected = rows_of([d[0] for d in want.description], want.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got_names == names, (got_names, names)
    missing, extra = expected - got, got - expected
    assert not missing and not extra, (len(missing), len(extra), list(missing.items())[:3], list(extra.items())[:3])
    return sum(got.values())
