"""Recovery of fragmented JPEGs: candidate blocks ranked by entropy, marker validity and decodability, then spliced.

Offsets and scores are shuffled, images only where they are given whole and the rows that concern them are too many to go
to the images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelode.functions.bytesx import recovered_filename
from bytelode.functions.huffman import context, count_all
from bytelode.sources.scratch import settle
from bytelode.sources.store import Ranges, read_ranges

from . import intervals

LEAST_BLOCK, LEAST_FRAGMENT, POOL = 16, 4, 3
#: Blocks of a bin, bytes of candidates that are read and decoded together (one candidate at least), and bytes of blocks that are scored together.
BIN_BLOCKS, TOGETHER, SCORED = 2048, 64 << 20, 1 << 20


@dataclass(frozen=True)
class RecoveryConfig:
    block_size: int = 512
    search_window: int = 50 << 20
    max_candidates: int = 3
    min_entropy: float = 7.0
    min_ff_validity: float = 0.9
    huffman_validation: bool = True


def block_entropy(data: bytes, starts: np.ndarray, size: int) -> np.ndarray:
    """Shannon entropy in bits of the blocks at starts; a block at the end may be short."""
    out = np.zeros(len(starts))
    values = np.frombuffer(data, np.uint8)
    full = starts <= len(values) - size
    if full.any():
        windows, whole = np.lib.stride_tricks.sliding_window_view(values, size), np.flatnonzero(full)
        share, log = _terms(size)
        for lo in range(0, len(whole), 4096):
            some = whole[lo : lo + 4096]
            table = np.bincount((np.arange(len(some))[:, None] * 256 + windows[starts[some]]).ravel(), minlength=len(some) * 256).reshape(-1, 256)
            out[some] = -np.einsum("ij,ij->i", share[table], log[table])
    for k in np.flatnonzero(~full).tolist():
        table = np.bincount(values[starts[k] :], minlength=256)
        share, log = _terms(len(values) - int(starts[k]))
        out[k] = -np.einsum("ij,ij->i", share[table][None], log[table][None])[0]
    return out


@lru_cache(8)
def _terms(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of a block, and its logarithm, that a byte value has which is met 0 to size times."""
    share = np.arange(size + 1) / max(size, 1)
    return share, np.log2(np.where(share > 0, share, 1))


def validity(flat: np.ndarray, owner: np.ndarray, end: np.ndarray) -> np.ndarray:
    """`ff_validity` of each stretch of flat bytes, one after the other: in a run of FF bytes every second one starts a pair, and a pair ends within its stretch."""
    ff = np.flatnonzero(flat == 0xFF)
    new = np.ones(len(ff), bool)
    new[1:] = (ff[1:] != ff[:-1] + 1) | (owner[ff[1:]] != owner[ff[:-1]])
    run = ff[np.maximum.accumulate(np.where(new, np.arange(len(ff)), 0))] if len(ff) else ff
    first = ff[((ff - run) % 2 == 0) & (ff + 1 < end[owner[ff]])]
    second, of = flat[first + 1], owner[first]
    may = (second == 0) | (second == 0xD9) | ((second >= 0xD0) & (second <= 0xD7))
    seen = np.bincount(of, minlength=len(end))
    return np.where(seen > 0, np.bincount(of, may, len(end)) / np.maximum(seen, 1), 1.0)


def block_validity(data: bytes, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Of each block at starts `ff_validity`; size may differ from block to block."""
    out = np.ones(len(starts))
    values, sizes = np.frombuffer(data, np.uint8), np.broadcast_to(size, starts.shape)
    for lo in range(0, len(starts), 4096):
        at = starts[lo : lo + 4096]
        n = np.minimum(sizes[lo : lo + 4096], len(values) - at)
        end = np.cumsum(n)
        out[lo : lo + 4096] = validity(values[np.repeat(at - end + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(at)), n), end)
    return out


class Held:
    """An image whose bytes are at hand, as `Ranges` reads it."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def size(self, _: str) -> int:
        return len(self.data)

    def read(self, _: str, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length] if offset >= 0 else b""


#: Scores rows of images: of (reader, row) pairs it makes the images and columns of batches, those of the schema after image_id.
Score = Callable[[Iterator[tuple[Held | Ranges, dict]]], Iterator[tuple[pa.Array, list[pa.Array]]]]


def _visit(images: DataFrame | None, rows: DataFrame, score: Score, schema: str) -> DataFrame:
    """score of all rows, where their images are or, where image_id is a path (images is None), by ranges read for each row.

    rows come from a table, so Spark knows their size: below its threshold for broadcasts they go to the images, which stay
    where they are; beyond it both are dealt by image_id. Read by ranges, nothing but the rows is ever dealt out.
    """
    names = ["image_id", *(x.split(" ", 1)[0] for x in schema.split(", "))]

    def records(batch: pa.RecordBatch | pa.StructArray, columns: list[str]) -> Iterator[dict]:
        values = [batch.field(k) if isinstance(batch, pa.StructArray) else batch.column(k) for k in range(len(columns))]
        for row in zip(*(v.to_pylist() for v in values), strict=True):
            yield dict(zip(columns, row, strict=True))

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Ranges()
        for image, columns in score((reader, row) for batch in batches for row in records(batch, batch.schema.names)):
            yield pa.RecordBatch.from_arrays([image, *columns], names)
        reader.close()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Held, dict]]:
        for batch in batches:
            lists = batch.column("rows")
            flat = lists.flatten()
            row = records(flat, [f.name for f in flat.type])
            for image, content, n in zip(batch.column("image_id").to_pylist(), batch.column("content"), lists.value_lengths().to_pylist(), strict=True):
                held = Held(content.as_py() or b"")
                for _ in range(n):
                    yield held, {"image_id": image, **next(row)}

    def at_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, columns in score(asked(batches)):
            yield pa.RecordBatch.from_arrays([image, *columns], names)

    if images is None:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(tasks).sortWithinPartitions("image_id").mapInArrow(by_range, f"image_id string, {schema}")
    by_image = rows.groupBy("image_id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "image_id"))).alias("rows"))
    return images.join(by_image, "image_id").select("image_id", "content", "rows").mapInArrow(at_hand, f"image_id string, {schema}")


def incomplete(files: DataFrame) -> DataFrame:
    """Incomplete JPEGs: image_id, seq, filename, header_at, fragment_len, search_at."""
    run = F.col("byte_runs")[0]
    rows = files.where("file_type = 'jpeg' and jpeg_scan is not null and jpeg_scan.status <> 'complete' and size(byte_runs) > 0")
    end = run["img_offset"] + run["len"]
    return rows.select("image_id", "seq", "filename", run["img_offset"].alias("header_at"), run["len"].alias("fragment_len"), F.coalesce("jpeg_scan.fragmentation_point_img_offset", end).alias("search_at"))


def pool(scored: DataFrame, c: RecoveryConfig) -> DataFrame:
    """Per JPEG the best 3n blocks by entropy, and the direct one: if it isn't among them, it is put in front (prior 0, entropy 0)."""
    enough = F.coalesce(F.col("entropy") >= c.min_entropy, F.lit(False))
    rank = F.row_number().over(Window.partitionBy("image_id", "seq").orderBy(F.desc_nulls_last(F.when(enough, F.col("entropy"))), "offset"))
    among = enough & (F.col("prior") <= POOL * c.max_candidates)
    rows = scored.withColumn("prior", rank).where(among | F.col("direct"))
    return rows.withColumn("among", among).withColumn("entropy", F.when(F.col("among"), F.col("entropy")).otherwise(0.0)).withColumn("prior", F.when(F.col("among"), F.col("prior")).otherwise(0)).drop("among")


def rank_by_validity(rows: DataFrame, c: RecoveryConfig) -> DataFrame:
    """Blocks of too few valid FF pairs go, except the direct one; the best n by validity, then entropy, stay as rank1."""
    rank = F.row_number().over(Window.partitionBy("image_id", "seq").orderBy(F.desc("ff"), F.desc("entropy"), "prior"))
    return rows.where((F.col("ff") >= c.min_ff_validity) | F.col("direct")).withColumn("rank1", rank).where(F.col("rank1") <= c.max_candidates)


def rank_by_units(rows: DataFrame) -> DataFrame:
    """The winner: most decodable units first (where the header could be read), then as before; only splices with an end marker count."""
    order = [F.desc(F.coalesce("units", F.lit(0))), F.desc("ff"), F.desc("entropy"), F.col("rank1")]
    unread = F.col("units").isNull()
    rank = F.row_number().over(Window.partitionBy("image_id", "seq").orderBy(F.when(unread, F.col("rank1")).otherwise(0), *order))
    return rows.where("size is not null").withColumn("rank2", rank).where("rank2 = 1")


def bin_size(c: RecoveryConfig) -> int:
    """Bytes of the bins that blocks are scored and joined in."""
    return c.block_size * BIN_BLOCKS


def windows(jpegs: DataFrame, c: RecoveryConfig) -> DataFrame:
    """Where each JPEG's continuation is looked for: blocks from lo to hi, without those within its fragment."""
    start = F.expr(f"search_at div {c.block_size}") * c.block_size
    return jpegs.select("image_id", "seq", start.alias("lo"), (start + c.search_window).alias("hi"), F.col("header_at").alias("skip_lo"), (F.col("header_at") + F.col("fragment_len")).alias("skip_hi"))


def _scores(c: RecoveryConfig) -> Score:
    """The blocks of a bin (seq is null) that reach the least entropy, or the one right after a fragment, whatever its entropy.

    What is read for many rows is scored at once, for small images take more calls than bytes.
    """
    block = c.block_size

    def scored(parts: list[bytes], rows: list[dict], steps: list[int]) -> tuple[pa.Array, list[pa.Array]]:
        """Of each part the blocks of so many steps from its start, or if that is -1 the part itself."""
        data, size = b"".join(parts), np.array([len(p) for p in parts], np.int64)
        base, n = np.cumsum(size) - size, np.array(steps, np.int64)
        direct = n < 0
        n[direct] = 1
        owner = np.repeat(np.arange(len(parts)), n)
        offset = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * block
        starts, whole = base[owner] + offset, direct[owner]
        entropy = np.full(len(owner), np.inf)
        entropy[~whole] = block_entropy(data, starts[~whole], block)
        kept = entropy >= c.min_entropy
        kept[whole] = True
        owner, offset, starts, whole, entropy = (x[kept] for x in (owner, offset, starts, whole, entropy))
        ff = block_validity(data, starts, np.where(whole, size[owner], block))
        column = lambda k, kind: pa.array([r[k] for r in rows], kind).take(pa.array(owner))
        places = np.array([r["at"] for r in rows], np.int64)[owner] + offset
        return column("image_id", pa.string()), [column("seq", pa.int32()), pa.array(places), pa.array(entropy, mask=whole), pa.array(ff)]

    def score(asked: Iterator[tuple[Held | Ranges, dict]]) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
        held: tuple[list[bytes], list[dict], list[int]] = [], [], []
        taken = 0
        for reader, row in asked:
            path, at = row["image_id"], row["at"]
            if row["seq"] is not None:
                data, steps = reader.read(path, at, block), -1
                if len(data) < LEAST_BLOCK:
                    continue
            else:
                data, steps = reader.read(path, at, bin_size(c) + block), -(-min(bin_size(c), reader.size(path) - block - at) // block)
                if block < LEAST_BLOCK or steps <= 0:
                    continue
            for some, value in zip(held, (data, row, steps), strict=True):
                some.append(value)
            taken += len(data)
            if taken >= SCORED:
                yield scored(*held)
                held, taken = ([], [], []), 0
        if held[0]:
            yield scored(*held)

    return score


def candidates(images: DataFrame | None, jpegs: DataFrame, c: RecoveryConfig) -> DataFrame:
    """image_id, seq, offset, entropy, ff and direct: for each JPEG the blocks that can be among the best 3n, and the direct one.

    A block is scored once for all JPEGs whose windows it is in; windows meet blocks in a join on bins.
    """
    where = windows(jpegs, c)
    bins = intervals.covered(where, bin_size(c)).select("image_id", F.lit(None).cast("int").alias("seq"), (F.col("bin") * bin_size(c)).alias("at")).distinct()
    direct = where.select("image_id", "seq", F.col("skip_hi").alias("at"))
    asked = settle(bins.unionAll(direct), "bins")
    scores = settle(_visit(images, asked, _scores(c), "seq int, offset long, entropy double, ff double"), "scores")
    top = intervals.best(scores.where("seq is null").drop("seq"), where, ["image_id"], "seq", POOL * c.max_candidates, "entropy", bin_size(c)).drop("rank")
    direct = scores.where("seq is not null").select("image_id", "seq", "offset", F.lit(True).alias("direct"), F.col("ff").alias("direct_ff"))
    # the direct block is one of the best ones, or stands beside them without a score
    both = top.join(direct, ["image_id", "seq", "offset"], "full")
    return both.select("image_id", "seq", "offset", "entropy", F.coalesce("ff", "direct_ff").alias("ff"), F.coalesce("direct", F.lit(False)).alias("direct"))


def splices(c: RecoveryConfig) -> Score:
    """For each candidate, unless it is beyond the image, (seq, offset, entropy, ff, rank1, units, size): how far the splice decodes and where it ends."""
    most = max(1, min(1024, TOGETHER // max(c.search_window, 1)))
    kinds = {"seq": pa.int32(), "offset": pa.int64(), "entropy": pa.float64(), "ff": pa.float64(), "rank1": pa.int32()}

    def scored(asked: list[tuple[Held | Ranges, dict]]) -> tuple[pa.Array, list[pa.Array]]:
        parts = [(reader.read(row["image_id"], row["header_at"], row["fragment_len"]), reader.read(row["image_id"], row["offset"], c.search_window)) for reader, row in asked]
        contexts = {h: context(h) if c.huffman_validation else None for h in {h for h, _ in parts}}
        units = count_all([(contexts[header], rest) for header, rest in parts])
        sizes = []
        for header, rest in parts:
            end = (header + rest[:1]).find(b"\xff\xd9")
            if end < 0 and (at := rest.find(b"\xff\xd9")) >= 0:
                end = len(header) + at
            sizes.append(None if end < 0 else end + 2)
        there = [k for k, (_, rest) in enumerate(parts) if rest]
        rows = [asked[k][1] for k in there]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()]
        return pa.array([r["image_id"] for r in rows], pa.string()), [*columns, pa.array([units[k] for k in there], pa.int64()), pa.array([sizes[k] for k in there], pa.int64())]

    def score(asked: Iterator[tuple[Held | Ranges, dict]]) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
        while some := list(islice(asked, most)):
            yield scored(some)

    return score


def recover(images: DataFrame | None, files: DataFrame, config: RecoveryConfig | None = None) -> DataFrame:
    """One row for each JPEG that could be completed: names, method, scores, offsets and recovered_size; `spliced` adds the bytes.

    images has image_id and content. Without images each image_id is the path of a file, of any size, that all executors
    can open: of these only the ranges are read that are looked at, and no bytes are dealt out.
    """
    c = config or RecoveryConfig()
    jpegs = settle(incomplete(files).where(F.col("fragment_len") >= LEAST_FRAGMENT), "jpegs")
    best = rank_by_validity(pool(candidates(images, jpegs, c), c), c).join(jpegs.select("image_id", "seq", "header_at", "fragment_len"), ["image_id", "seq"])
    best = settle(best.select("image_id", "seq", "offset", "entropy", "ff", "rank1", "header_at", "fragment_len"), "blocks")
    won = rank_by_units(_visit(images, best, splices(c), "seq int, offset long, entropy double, ff double, rank1 int, units long, size long"))
    won = won.join(jpegs.select("image_id", "seq", "filename", "header_at", "fragment_len"), ["image_id", "seq"])
    method = F.when(F.col("offset") == F.col("header_at") + F.col("fragment_len"), "direct_continuation").otherwise("fragment_reassembly")
    return won.select("image_id", F.col("filename").alias("original_filename"), recovered_filename(F.col("filename")).alias("recovered_filename"), method.alias("recovery_method"), F.col("entropy").alias("entropy_score"), F.col("header_at").alias("header_img_offset"), F.col("offset").alias("continuation_img_offset"), F.col("size").alias("recovered_size"), F.col("ff").alias("ff_validity_score"), F.col("units").alias("huffman_mcu_count"), "fragment_len")


def spliced(images: DataFrame | None, recovered: DataFrame) -> DataFrame:
    """Rows of `recover` with their bytes (data): the fragment and what continues it, cut after the end marker. images as there."""
    head, rest = F.least("fragment_len", "recovered_size"), F.greatest(F.col("recovered_size") - F.col("fragment_len"), F.lit(0))
    if images is None:
        part = lambda df, at, n, name: read_ranges(df.withColumns({"path": F.col("image_id"), "offset": F.col(at), "length": n})).drop("path", "offset", "length").withColumnRenamed("bytes", name)
        both = part(part(recovered, "header_img_offset", head, "_head"), "continuation_img_offset", rest, "_rest")
        return both.select(*recovered.columns, F.concat("_head", "_rest").alias("data"))
    part = lambda at, n: F.substring("content", (F.col(at) + 1).cast("int"), n.cast("int"))
    return images.join(recovered, "image_id").select(*recovered.columns, F.concat(part("header_img_offset", head), part("continuation_img_offset", rest)).alias("data"))


def recovery_report(files: DataFrame, recovered: DataFrame) -> DataFrame:
    """incomplete_jpegs (short fragments included) and recovered, over all images."""
    return incomplete(files).agg(F.count("*").alias("incomplete_jpegs")).crossJoin(recovered.agg(F.count("*").alias("recovered")))
