"""Shared plumbing: tables, scratch tables in the cluster's shared folder, and byte views of Arrow text."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.sources.scratch import shared_folder

#: Bytes of text that a numpy kernel works on at once; a longer text is one piece of its own.
PIECE_BYTES = 1 << 20
#: Spark's own setting that lets the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made: ContextVar[list[str] | None] = ContextVar("scratch tables of the step", default=None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a local one where that is unset (tests)."""
    return shared_folder(spark)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: what follows survives lost executors without recomputing df.

    The shuffle files of the write go when it ends, as the table replaces them. The setting that says so is put back
    afterwards; a query of another thread that runs meanwhile loses files that it may make again, never a result.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    _at[out] = at
    if (made := _made.get()) is not None:
        made.append(at)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; other DataFrames are let alone."""
    for table in tables:
        if at := _at.pop(table, None):
            delete(table.sparkSession, [at])


def standing_for(view: DataFrame, table: DataFrame) -> DataFrame:
    """From now on, discarding view deletes the scratch table that it reads."""
    _at[view] = _at.pop(table)
    return view


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of scratch tables; those already gone are passed over."""
    for at in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Gather the folders of all scratch tables that are made inside, for their owner to delete."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, the same ones for the same data: those with the least hash of the key, which should not repeat."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def one_text(docs: DataFrame, sample: DataFrame, *columns: str) -> DataFrame:
    """text and the given columns of a bounded sample of distinct doc_ids: of texts that share a doc_id the one of least hash."""
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min_by(F.struct("text", *columns), F.struct(F.xxhash64("text"), "text")).alias("z"))
    return rows.select("z.text", *(F.col(f"z.{c}") for c in columns))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets, null mask) of an Arrow text or binary column; nulls are empty."""
    nulls = np.asarray(column.is_null())
    column = column.cast(pa.large_binary())
    if nulls.any():
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at, nulls


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows lo..hi with about `most` bytes together: (lo, hi, their bytes, their offsets from 0)."""
    data, at, _ = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
