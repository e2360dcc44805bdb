"""Token counts of documents in flat token files that have no index: only an end-of-document id between documents.

A file is read in blocks of fixed size, each by whichever task gets it. In every block the separators are found in one
vectorised comparison; then a prefix scan over the blocks of a file (within stretches of blocks, then over the
stretches) carries the number of documents so far and the place of the last separator across block boundaries.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import discard, stash

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id that ends a document: free in this vocabulary.
END = 50_256
#: Tokens of a block, and blocks that one window orders.
BLOCK, STRETCH = 1 << 16, 1024
_FILE = "file_id long, block_no long, payload binary, doc_no long, doc_id long"


def encoding(path: str = RANKS):  # noqa: ANN201
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of so much white space are taken out of the tokeniser's pattern, which goes back over them step by step.
LONG_RUN = 100
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def encode(coder, text: str, long: int = LONG_RUN) -> np.ndarray:  # noqa: ANN001
    """The ids of a text, as the library gives them, however long its runs of white space are.

    Of a run of white space all but the last character are one piece under the pattern, or the whole run at the text's end.
    """
    out, start = [], 0
    for run in re.finditer(f"{_WHITE}{{{long},}}", text):
        stop = run.end() - (run.end() < len(text))
        out += [coder.encode_to_numpy(text[start : run.start()]), np.array(coder._encode_single_piece(text[run.start() : stop].encode("utf-8", "surrogatepass")), np.uint32)]
        start = stop
    return np.concatenate([*out, coder.encode_to_numpy(text[start:])])


def _write(path: str, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file_id = encoding(path), TaskContext.get().partitionId()
        names = [x.split()[0] for x in _FILE.split(", ")]
        rest, block_no, doc_no = [], 0, 0
        held = 0

        def cut(tokens: np.ndarray) -> pa.RecordBatch:
            n = -(-len(tokens) // block)
            payload = [tokens[k * block : (k + 1) * block].tobytes() for k in range(n)]
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([file_id] * n, pa.int64()), pa.array(range(block_no, block_no + n), pa.int64()), pa.array(payload, pa.binary()), none, none], names)

        for batch in batches:
            for text in batch.column("text"):
                ids = encode(coder, text.as_py() or "").astype("<u2")
                rest.append(np.append(ids, np.uint16(END)))
                held += len(ids) + 1
                if held >= 16 * block:
                    tokens = np.concatenate(rest)
                    whole = len(tokens) // block * block
                    yield cut(tokens[:whole])
                    block_no += whole // block
                    rest, held = [tokens[whole:]], len(tokens) - whole
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file_id] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(doc_no, doc_no + n), pa.int64()), batch.column("doc_id")], names)
            doc_no += n
        if held:
            yield cut(np.concatenate(rest))

    return run


def flat_files(docs: DataFrame, path: str = RANKS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Tokenise docs into one flat stream for each partition, in the shared folder: (blocks, which document was written where).

    Blocks are cut every `block` tokens (16-bit, little-endian) wherever documents end. A null text is written as an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_write(path, block), _FILE)
    files = stash(rows, "tokens")
    return _parts(files)


def _parts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.where("block_no is not null").select("file_id", "block_no", "payload"), files.where("doc_no is not null").select("file_id", "doc_no", "doc_id")


class _FileBlocks(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.size, self.many = options["path"].split("\n"), 2 * int(options["block"]), 64

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((p, lo)) for p in self.paths for lo in range(0, os.path.getsize(p), self.size * self.many)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, lo = partition.value
        with open(path, "rb") as f:
            f.seek(lo)
            for k in range(lo // self.size, lo // self.size + self.many):
                if part := f.read(self.size):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([part], pa.binary())], ["file_id", "block_no", "payload"])


class FileBlocks(DataSource):
    """format("token_blocks"): runs of blocks of flat files of any size, on paths that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        return "file_id string, block_no long, payload binary"

    def reader(self, schema: object) -> DataSourceReader:
        return _FileBlocks(self.options)


def read_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of the existing flat files of 16-bit ids in a folder, of any size; the folder is mounted on every executor."""
    spark.dataSource.register(FileBlocks)
    paths = [p for n in sorted(os.listdir(path)) if os.path.isfile(p := os.path.join(path, n))]
    return spark.read.format("token_blocks").option("block", block).load("\n".join(paths))


def _ends(end: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = batch.column("payload").fill_null(b"").cast(pa.large_binary())
            _, where, data = payload.buffers()
            at = np.frombuffer(where, np.int64)[payload.offset : payload.offset + len(payload) + 1] // 2
            tokens = np.frombuffer(data, "<u2", count=int(at[-1])) if data and at[-1] else np.zeros(0, "<u2")
            found = np.flatnonzero(tokens[at[0] :] == end) + at[0]
            cuts = np.searchsorted(found, at)
            base = np.asarray(batch.column("block_no")) * block
            ends = found - np.repeat(at[:-1] - base, np.diff(cuts))
            rows = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(ends, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("block_no"), pa.array(np.diff(at)), rows], ["file_id", "block_no", "n_tokens", "ends"])

    return run


def scan(blocks: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """file_id, doc_no, start, n_tokens and ended for each document of flat files given in blocks.

    Every block of a file but its last holds exactly `block` tokens. Empty documents count 0 tokens. Tokens after a file's
    last separator are a document with ended = false. Two blocks of the same number are a fault of the input.
    """
    kind = dict(blocks.dtypes)["file_id"]
    found = blocks.mapInArrow(_ends(end, block), f"file_id {kind}, block_no long, n_tokens long, ends array<long>")
    found = found.select("file_id", "block_no", F.expr(f"block_no div {STRETCH}").alias("stretch"), "ends", F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last"), (F.col("block_no") * block + F.col("n_tokens")).alias("stop"))
    found = stash(found, "separators")
    total = found.groupBy("file_id", "stretch").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("file_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("file_id", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("last0"))
    inside = Window.partitionBy("file_id", "stretch").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file_id", "stretch", "ends", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"), F.max("last").over(inside).alias("last1")).join(total, ["file_id", "stretch"])
    carried = carried.where(F.size("ends") > 0).select("file_id", (F.col("n0") + F.col("n1")).alias("first"), F.coalesce("last1", "last0").alias("before"), "ends")
    one = carried.select("file_id", "first", F.posexplode(F.arrays_zip(F.col("ends"), F.concat(F.array("before"), F.slice("ends", 1, F.size("ends") - 1)).alias("before"))).alias("k", "z"))
    whole = one.select("file_id", (F.col("first") + F.col("k")).alias("doc_no"), (F.col("z.before") + 1).alias("start"), (F.col("z.ends") - F.col("z.before") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = found.groupBy("file_id").agg(F.sum("n").alias("doc_no"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop"))
    tail = tail.where("stop > start").select("file_id", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionAll(tail)


def count(docs: DataFrame, path: str = RANKS, block: int = BLOCK) -> DataFrame:
    """doc_id, file_id, doc_no, start and n_tokens for each row of docs, counted from the flat files that docs are written to.

    Null and empty texts count 0 tokens; repeated rows and null ids are documents like others; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_write(path, block), _FILE)
    files = stash(rows, "tokens")
    blocks, written = _parts(files)
    out = scan(blocks, END, block).join(written, ["file_id", "doc_no"]).select("doc_id", "file_id", "doc_no", "start", "n_tokens")
    out = stash(out, "counts")
    discard(files)
    return out
