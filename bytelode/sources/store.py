"""Files in folders that driver and executors share: written with a commit, read by ranges.

Paths may be plain ones or addresses of any store that pyarrow opens (file, hdfs, s3 and so on).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of ranges that one batch holds, at most, unless a single range is longer.
BATCH = 32 << 20


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path there."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    if re.match(r"\w[\w+.-]+:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


# --- files, written with a commit ----------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class _FileWriter(DataSourceWriter):
    """A task writes beside the target, then moves its files there and leaves a list of their names until the job ends.

    A task that fails leaves nothing; of a job that fails the files of tasks that had ended are taken away again.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.uri, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at = store(self.uri)
        folder = f"{at}/.part-{uuid.uuid4().hex}"
        names: list[str] = []
        try:
            system.create_dir(folder, recursive=True)
            for row in iterator:
                name = row["filename"]
                if "/" in name or name in ("", ".", "..") or name.startswith(".part-"):
                    raise ValueError(f"not a file name: {name!r}")
                with system.open_output_stream(f"{folder}/{len(names)}", compression=None) as out:
                    out.write(row["data"] or b"")
                names.append(name)
            with system.open_output_stream(f"{folder}/names", compression=None) as out:
                out.write("\0".join(names).encode())
            for k, name in enumerate(names):
                system.move(f"{folder}/{k}", f"{at}/{name}")
        except BaseException:
            _take_back(system, at, folder)
            raise
        return _Written(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = store(self.uri)
        for m in messages:
            if m is not None:
                system.delete_dir(m.folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = store(self.uri)
        for m in messages:
            if m is not None:
                _take_back(system, at, m.folder)


def _take_back(system: fs.FileSystem, at: str, folder: str) -> None:
    """Delete the files that the task of this folder has moved to the target, and the folder."""
    if system.get_file_info(f"{folder}/names").type == fs.FileType.File:
        with system.open_input_stream(f"{folder}/names", compression=None) as f:
            names = [n for n in f.read().decode().split("\0") if n]
        for k, name in enumerate(names):
            moved = system.get_file_info(f"{folder}/{k}").type == fs.FileType.NotFound
            if moved and system.get_file_info(f"{at}/{name}").type == fs.FileType.File:
                system.delete_file(f"{at}/{name}")
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


class FileSink(DataSource):
    """format("files"): each row (filename, data) as a file of a folder. Names should differ; one written twice is the last one's."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "filename string, data binary"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options, overwrite)


def write_files(payload: DataFrame, folder: str) -> None:
    """Write the data of every row (filename, data) where the row is, into a folder that all executors share."""
    payload.sparkSession.dataSource.register(FileSink)
    payload.select("filename", "data").write.format("files").mode("append").save(folder)


# --- ranges of files -----------------------------------------------------------------------------------------------------


class Ranges:
    """Reads ranges of files and knows their sizes; the file read last stays open."""

    def __init__(self) -> None:
        self.path: str | None = None
        self.file: pa.NativeFile | None = None

    def _open(self, path: str) -> pa.NativeFile:
        if path != self.path:
            self.close()
            system, at = store(path)
            self.path, self.file = path, system.open_input_file(at)
        return self.file

    def size(self, path: str) -> int:
        return self._open(path).size()

    def read(self, path: str, offset: int, length: int) -> bytes:
        """The bytes of a range, as far as the file goes."""
        file = self._open(path)
        length = min(length, file.size() - offset)
        return file.read_at(length, offset) if length > 0 and offset >= 0 else b""

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Ranges()
    for batch in batches:
        rows, lo, held = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True)), 0, 0
        found: list[bytes] = []
        for k, row in enumerate(rows):
            found.append(reader.read(*row))
            held += len(found[-1])
            if held >= BATCH or k == len(rows) - 1:
                part = batch.slice(lo, k + 1 - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "bytes"])
                lo, held, found = k + 1, 0, []
    reader.close()


def read_ranges(ranges: DataFrame) -> DataFrame:
    """ranges (path, offset, length and any other columns) with their bytes: only these are read, where the rows are."""
    kinds = ", ".join(f"`{n}` {k}" for n, k in ranges.dtypes)
    return ranges.mapInArrow(_with_bytes, f"{kinds}, bytes binary")


class _Part(InputPartition):
    def __init__(self, path: str, group: int) -> None:
        self.path, self.group = path, group


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]

    def partitions(self) -> list[InputPartition]:
        system, at = store(self.uri)
        table = ds.dataset(at, format="parquet", filesystem=system)
        return [_Part(f.path, k) for f in table.get_fragments() for k in range(f.num_row_groups)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, _ = store(self.uri)
        with system.open_input_file(partition.path) as raw:
            rows = pq.ParquetFile(raw).read_row_group(partition.group, columns=["path", "offset", "length"])
        yield from _with_bytes(iter(rows.to_batches()))


class RangeSource(DataSource):
    """format("ranges"): the ranges that a Parquet table (path, offset, length) names, one partition for each of its row groups."""

    @classmethod
    def name(cls) -> str:
        return "ranges"

    def schema(self) -> str:
        return "path string, offset long, length long, bytes binary"

    def reader(self, schema: object) -> DataSourceReader:
        return _RangeReader(self.options)


def load_ranges(spark: SparkSession, table: str) -> DataFrame:
    spark.dataSource.register(RangeSource)
    return spark.read.format("ranges").load(table)
