"""Shared helpers: the cluster's shared folder, written intermediate tables, table reading."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dir: list[str] = []
_scopes: list[list[str]] = []
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may do without: it gets a
    temporary one; a cluster would write where nobody else can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="refscan-"))
    return _own_dir[0]


def written(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    Within ``temporary`` it is deleted at the end, or with ``outside`` at the end of the next scope outside, if any."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/refscan/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(before), 1_000) if int(before) > 0 else 1_000))  # texts are long: smaller batches to Python workers
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    scopes = _scopes[:-1] if outside else _scopes
    if scopes:
        scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``written``, wherever the shared folder is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Deletes the table that ``written`` gave ``df`` for, if it did; its readers must be done."""
    if path := _places.pop(df, None):
        deleted(df.sparkSession, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within are deleted at the end: what outlives them has to be written ``outside``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            deleted(spark, path)


def cuts(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """From and to of consecutive parts with so many rows and bytes, at the most, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield at, end
        at = end


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 1 << 21, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded rows and bytes of text, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at, end in cuts(batch.column(column), rows, size):
            yield batch.slice(at, end - at)
    freed()


def freed() -> None:
    """Gives unused memory back to the system: a worker lives on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not on every system
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array, rows: int = 500, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts of a column in parts, as ``slices`` gives them."""
    for at, end in cuts(column, rows, size):
        yield column.slice(at, end - at).cast(pa.binary()).to_pylist()
    freed()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        found = f"_{name}"
        while found in taken:
            found = f"_{found}"
        taken.add(found)
        out.append(found)
    return out


def salts(spark: SparkSession) -> int:
    """Parts that rows of one key are dealt to."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sampled(share: float, *columns: str) -> Column:
    """Whether a row is in the sample of that share, by a hash of the columns."""
    fine = 1 << 48
    return F.pmod(F.xxhash64(*columns), F.lit(fine)) < F.lit(math.ceil(min(1.0, share) * fine))


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only (null text: empty), so that other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
