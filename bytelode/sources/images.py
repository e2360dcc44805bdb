"""Images (raw byte sequences) as rows, and the chunks that they are searched in."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import store

CHUNK = 100 << 20
IMAGE = "image_id string, content binary"


def from_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole files up to 2 GiB each as images. Missing and unreadable files are passed over; the rest goes on."""
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(paths)
    return found.select(F.col("path").alias("image_id"), "content")


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, errors = [], []
        for path in batch.column("path").to_pylist():
            size, error = None, None
            try:
                system, at = store(path)
                with system.open_input_file(at) as f:
                    size = f.size()
                    f.read_at(1, 0) if size else None
            except (OSError, ValueError, TypeError) as e:
                error = f"{type(e).__name__}: {e}"
            sizes.append(size)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["path", "size", "error"])


def probe(paths: DataFrame) -> DataFrame:
    """path, size and error of each file: error says why a file can't be opened or read, and is null for the others, with which a run goes on."""
    return paths.select("path").mapInArrow(_probed, "path string, size long, error string")


def from_table(df: DataFrame, image_id: str, content: str) -> DataFrame:
    """A column of a table as images; text counts as UTF-8."""
    kind = dict(df.dtypes)[content]
    return df.select(F.col(image_id).cast("string").alias("image_id"), (F.encode(content, "UTF-8") if kind == "string" else F.col(content)).alias("content"))


def skip_blocks(images: DataFrame, blocks: int, block_size: int = 512) -> DataFrame:
    """Images without their first blocks; offsets count from what is left."""
    return images.withColumn("content", F.expr(f"substring(content, {blocks * block_size + 1}, 2147483647)")) if blocks else images


def chunks(images: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """image_id, chunk_no, chunk_offset, bytes: no overlap, so what straddles a boundary is not found there. Empty images have none."""
    size = F.octet_length("content")
    starts = F.sequence(F.lit(0).cast("long"), (size - 1).cast("long"), F.lit(chunk_size).cast("long"))
    rows = images.where(size > 0).select("image_id", "content", F.posexplode(starts).alias("chunk_no", "chunk_offset"))
    return rows.select("image_id", "chunk_no", "chunk_offset", F.substring("content", (F.col("chunk_offset") + 1).cast("int"), F.lit(chunk_size)).alias("bytes"))


def chunks_of_files(spark: SparkSession, paths: list[str], chunk_size: int = CHUNK) -> DataFrame:
    """The chunks of files of any size."""
    spark.dataSource.register(ImageChunks)
    return spark.read.format("image_chunks").option("chunkSize", chunk_size).load("\n".join(paths))


class _Range(InputPartition):
    def __init__(self, path: str, no: int, offset: int, size: int) -> None:
        self.path, self.no, self.offset, self.size = path, no, offset, size


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.size, self.skip = options["path"].split("\n"), int(options.get("chunkSize", CHUNK)), int(options.get("skipBytes", 0))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            end = os.path.getsize(path)
            out += [_Range(path, k, at, min(self.size, end - at)) for k, at in enumerate(range(self.skip, end, self.size))]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.offset)
            yield partition.path, partition.no, partition.offset - self.skip, f.read(partition.size)


class ImageChunks(DataSource):
    """format("image_chunks"): one partition for each chunk of files of any size, on paths (one a line) that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "image_chunks"

    def schema(self) -> str:
        return "image_id string, chunk_no int, chunk_offset long, bytes binary"

    def reader(self, schema: object) -> DataSourceReader:
        return _ChunkReader(self.options)
