"""One text file from rows in order: parts written side by side, then put together by one task, block by block."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .scratch import discard, settle, shared_path
from .store import store

_COPIED = 1 << 20


def _parts(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = store(folder)
        system.create_dir(at, recursive=True)
        part, name, size = TaskContext.get().partitionId(), f"{at}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for line in batch.column("line"):
                    data = (line.as_py() or "").encode()
                    out.write(data)
                    size += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([size], pa.int64())], ["part", "name", "size"])

    return run


def _joined(target: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = store(target)
        folder = at.rpartition("/")[0]
        if folder:
            system.create_dir(folder, recursive=True)
        draft, total = f"{folder or '.'}/.draft-{uuid.uuid4().hex}", 0
        with system.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for name in batch.column("name").to_pylist():
                    with store(name)[0].open_input_stream(name, compression=None) as part:
                        while data := part.read(_COPIED):
                            out.write(data)
                            total += len(data)
        system.move(draft, at)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["bytes"])

    return run


def write_ordered(lines: DataFrame, order: list[str], target: str) -> int:
    """Write column line of all rows, in order, as one file, which replaces an older one as a whole; its size in bytes.

    Ranges of rows are sorted and written by many tasks; only the copy of what they wrote is one task's, a block at a time.
    The target is a path that all executors can open.
    """
    spark = lines.sparkSession
    folder = shared_path(spark, "lines")
    sorted_ = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
    parts = settle(sorted_.mapInArrow(_parts(folder), "part long, name string, size long"), "parts")
    total = parts.repartition(1).sortWithinPartitions("part").select("name").mapInArrow(_joined(target), "bytes long").agg({"bytes": "max"}).first()[0]
    discard(parts)
    return total or 0
