"""Tables written between steps, in the folder that driver and executors share, and their end."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made: ContextVar[list[DataFrame] | None] = ContextVar("tables of the step", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset one machine makes do with a local folder; a cluster, whose machines would
    each write to their own, gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="bytelode-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, at: str):  # noqa: ANN202
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is put there goes with the application."""
    at = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    store, path = _path(spark, at)
    store.deleteOnExit(path)
    return at


def settle(rows: DataFrame, label: str = "rows") -> DataFrame:
    """rows, written to the shared folder and read back: made once, safe from lost executors, of a size that Spark knows.

    The table goes when it is discarded, when the step that `owned` it ends, or else with the application.
    """
    spark = rows.sparkSession
    at = shared_path(spark, label)
    rows.write.parquet(at)
    out = spark.read.schema(rows.schema).parquet(at)
    _at[out] = at
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more; other DataFrames are let alone."""
    for table in tables:
        if at := _at.pop(table, None):
            store, path = _path(table.sparkSession, at)
            store.delete(path, True)


@contextmanager
def owned() -> Iterator[list[DataFrame]]:
    """Tables that are made inside go at its end, but for those that `keep` takes out."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        discard(*made)


def keep(table: DataFrame) -> DataFrame:
    """The innermost step does not own this table; the one around it does, if any, when it ends."""
    made = _made.get()
    if made is not None and any(x is table for x in made):
        made[:] = [x for x in made if x is not table]
    return table
