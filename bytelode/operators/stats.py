"""Byte statistics of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recover import block_entropy


def _entropies(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, content in zip(batch.column("image_id").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() or b""
                size = block or max(len(data), 1)
                starts = np.arange(0, max(len(data), 0 if block else 1), size)
                e = block_entropy(data, starts, size) if data else np.zeros(len(starts))
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(e, pa.float64())], ["image_id", "offset", "entropy"])

    return run


def entropies(images: DataFrame, block: int = 0) -> DataFrame:
    """image_id, offset and Shannon entropy in bits of each block of images, or of each whole image; an empty one has 0."""
    return images.select("image_id", "content").mapInArrow(_entropies(block), "image_id string, offset long, entropy double")


def top_blocks(scored: DataFrame, n: int) -> DataFrame:
    """The n blocks of highest entropy of each image, ranked; equal ones (to 9 digits) by offset."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.round("entropy", 9)), "offset"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pc.dictionary_encode(batch.column("image_id"), null_encoding="encode")
        data = batch.column("bytes").fill_null(b"").cast(pa.large_binary())
        at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        values = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]] if data.buffers()[2] else np.zeros(0, np.uint8)
        owner = np.asarray(ids.indices).astype(np.int64)
        table = np.zeros(256 * len(ids.dictionary), np.int64)
        for k, (lo, hi) in enumerate(zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)):
            table[256 * owner[k] : 256 * owner[k] + 256] += np.bincount(values[lo:hi], minlength=256)
        found = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(found // 256)), pa.array((found % 256).astype(np.int32)), pa.array(table[found])], ["image_id", "byte", "n"])


def byte_counts(chunks: DataFrame) -> DataFrame:
    """image_id, byte and n: how often each byte stands in an image, from pieces of it (image_id, bytes) in any order and number.

    Pieces are counted where they are; what is dealt out is at most 256 numbers for each image and batch.
    """
    return chunks.select("image_id", "bytes").mapInArrow(_lanes, "image_id string, byte int, n long").groupBy("image_id", "byte").agg(F.sum("n").alias("n"))


def entropy_of(counts: DataFrame) -> DataFrame:
    """image_id and Shannon entropy in bits from `byte_counts`; an image without bytes has no row there, and none here."""
    total = counts.groupBy("image_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select("image_id", F.greatest(F.log2("t") - F.col("s") / F.col("t"), F.lit(0.0)).alias("entropy"))
