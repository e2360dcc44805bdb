"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a SentencePiece model (B) cover the same bytes.

Both tokenise a space and the text. In a batch of documents every token has a place in bytes; an as-of merge, keyed by
document, gives for each token start the token of the other side that covers it. The two directions together are all
overlaps, and places where tokens of both sides end cut them into groups.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import discard, standing_for, stash
from .tokencount import encode

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text that are aligned at once (a longer text is aligned alone).
PIECE = 1 << 20
#: Id pairs whose counts travel with the tasks, at most; those of the rarer pairs come by a join.
HEAD = 1 << 19
_LINKS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
_KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_FULL = "doc_id long, a array<int>, a_end array<long>, b array<int>, b_end array<long>, link_a array<int>, link_b array<int>, group_end array<long>"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Pair:
    """The two vocabularies, as they travel to the tasks: ranks of A's entries, the raw bytes of B's pieces and B's model file."""

    ranks: dict[bytes, int]
    pieces: list[bytes]
    model: bytes

    def __post_init__(self) -> None:
        self.name = hashlib.blake2b(b"\0".join(self.ranks) + b"\0\0" + self.model).hexdigest()

    def open(self) -> Pair:
        """Make the tokenisers, once in a worker."""
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        by_id = {k: v for v, k in self.ranks.items()}
        raw = [by_id.get(k, b"") for k in range(max(by_id) + 1)]
        self.raw = [pa.array(raw, pa.large_binary()), pa.array(self.pieces, pa.large_binary())]
        self.size = [np.array([len(x) for x in side], np.int64) for side in (raw, self.pieces)]
        most = max(map(len, (raw, self.pieces)))
        self.signs = pa.array([f"{k}{sign}" for sign in ",|;" for k in range(most)], pa.large_string())
        self.most = most
        return self


def load(byte_bpe: str = BYTE_BPE, model: str = pieces.MODEL) -> Pair:
    """Read the vocabularies where the driver runs.

    A's entries must be merges in the order of their ids that each encode to themselves; then merging by rank, as done
    here, and merging by the file's list of pairs are the same: a pair of neighbours outside of that list that would make
    an entry would also be left in that entry's own encoding.
    """
    import sentencepiece
    from tokenizers import Tokenizer

    with open(byte_bpe, encoding="utf-8") as f:
        spec = json.load(f)
    library, letters = Tokenizer.from_file(byte_bpe), byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {t: k for t, k in spec["model"]["vocab"].items() if t not in special}
    ids = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if ids != sorted(ids) or any([x.id for x in library.model.tokenize(t)] != [k] for t, k in vocabulary.items()):
        raise ValueError(f"{byte_bpe}: an entry does not encode to itself, or merges are not in the order of ids")
    found = pieces.load(model)
    raw = [found.raw[lo:hi].tobytes() for lo, hi in zip(found.raw_at[:-1], found.raw_at[1:], strict=True)]
    return Pair({bytes(letters[c] for c in t): k for t, k in vocabulary.items()}, raw, sentencepiece.SentencePieceProcessor(model_file=model).serialized_model_proto())


@dataclass
class Aligned:
    """A batch of texts: tokens of both sides one after the other (side 0 is A), with owners, starts and ends in bytes."""

    n: int
    ids: list[np.ndarray]
    doc: list[np.ndarray]
    start: list[np.ndarray]
    end: list[np.ndarray]
    base: np.ndarray
    link: tuple[np.ndarray, np.ndarray]
    common: np.ndarray
    group: list[np.ndarray]

    def first(self, side: int) -> np.ndarray:
        """Where each text's tokens begin (n + 1 places)."""
        return np.searchsorted(self.doc[side], np.arange(self.n + 1))


def align(pair: Pair, texts: list[str]) -> Aligned:
    """Align some texts. Those that are empty, or whose tokens do not give back a space and the text, have no tokens."""
    n = len(texts)
    wanted = [f" {t}".encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(wanted), np.uint8)
    size = np.array([len(w) for w in wanted], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    out_a = [encode(pair.a, f" {t}") if t else () for t in texts]
    out_b = pair.b.encode(texts, num_threads=1)
    good = size > 0
    ids, doc = [], []
    for side, found in enumerate((out_a, out_b)):
        counted = np.array([len(x) for x in found], np.int64)
        ids.append(np.concatenate([np.asarray(x, np.int64) for x in found]) if n else np.zeros(0, np.int64))
        doc.append(np.repeat(np.arange(n), counted))
        length = np.bincount(doc[side], pair.size[side][ids[side]], n).astype(np.int64)
        good &= length == size
    for side in (0, 1):
        some = good[doc[side]]
        ids[side], doc[side] = ids[side][some], doc[side][some]
        joined = pair.raw[side].take(pa.array(ids[side]))
        joined = np.frombuffer(joined.buffers()[2], np.uint8, count=int(size[good].sum())) if len(ids[side]) else np.zeros(0, np.uint8)
        at = np.concatenate([[0], np.cumsum(size * good)])
        expected = data if good.all() else data[np.repeat(good, size)]
        wrong = np.flatnonzero(joined != expected)
        if len(wrong):
            bad = np.unique(np.searchsorted(at, wrong, "right") - 1)
            good[bad] = False
            for s in range(side + 1):
                some = good[doc[s]]
                ids[s], doc[s] = ids[s][some], doc[s][some]
    start, end = [], []
    for side in (0, 1):
        length = pair.size[side][ids[side]]
        ends = np.cumsum(length) + (base[:-1] - np.cumsum(size * good) + size * good)[doc[side]]
        start.append(ends - length)
        end.append(ends)
    a, b = (pd.DataFrame({"at": start[s], "doc": doc[s], "token": np.arange(len(ids[s]))}) for s in (0, 1))
    if len(a):
        of_a = pd.merge_asof(a, b, on="at", by="doc", suffixes=("", "_other"))["token_other"].to_numpy(np.int64)
        of_b = pd.merge_asof(b, a, on="at", by="doc", suffixes=("", "_other"))["token_other"].to_numpy(np.int64)
        inside = np.flatnonzero(start[0][of_b] != start[1])  # equal starts are in the other direction already
        link = np.concatenate([np.arange(len(a)), of_b[inside]]), np.concatenate([of_a, inside])
        common = end[0][end[1][np.minimum(np.searchsorted(end[1], end[0]), len(b) - 1)] == end[0]]
    else:
        link, common = (np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64)
    return Aligned(n, ids, doc, start, end, base, link, common, [np.searchsorted(common, s, "right") for s in start])


def group_texts(pair: Pair, x: Aligned) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` for each text; empty where there are no tokens."""
    if not len(x.common):
        return [""] * x.n
    ga, gb = x.group
    place = [np.arange(len(ga)) + np.searchsorted(gb, ga), np.arange(len(gb)) + np.searchsorted(ga, gb, "right")]
    code = np.empty(len(ga) + len(gb), np.int64)
    for side, g in enumerate((ga, gb)):
        last = np.append(g[1:] != g[:-1], True)
        code[place[side]] = x.ids[side] + pair.most * np.where(last, 1 + side, 0)
    joined = pair.signs.take(pa.array(code))
    _, where, data = joined.buffers()
    at = np.frombuffer(where, np.int64)[: len(code) + 1][x.first(0) + x.first(1)]
    data = memoryview(data)
    return [hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_worker: dict[str, Pair] = {}


def _batches(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pair, pa.RecordBatch, Aligned]]:
    """Rows with their alignments, about PIECE bytes of text at a time."""
    pair = _worker.get(pair.name) or _worker.setdefault(pair.name, pair.open())
    for batch in batches:
        size = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0)).astype(np.int64))])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + PIECE, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            yield pair, part, align(pair, [t or "" for t in part.column("text").to_pylist()])
            lo = hi


def _lists(values: np.ndarray, counted: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(counted)])
    return pa.ListArray.from_arrays(at.astype(np.int32), pa.array(values, kind))


def _full(pair: Pair) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, x in _batches(pair, batches):
            a0, b0 = x.first(0), x.first(1)
            order = np.lexsort((x.link[1], x.link[0]))
            la, lb = x.link[0][order], x.link[1][order]
            owner = np.searchsorted(x.base, x.common - 1, "right") - 1
            columns = [part.column("doc_id")]
            for side, at in enumerate((a0, b0)):
                columns += [_lists(x.ids[side], np.diff(at), pa.int32()), _lists(x.end[side] - x.base[x.doc[side]], np.diff(at), pa.int64())]
            linked = np.bincount(x.doc[0][la], minlength=x.n)
            columns += [_lists(la - a0[x.doc[0][la]], linked, pa.int32()), _lists(lb - b0[x.doc[0][la]], linked, pa.int32())]
            columns += [_lists(x.common - x.base[owner], np.bincount(owner, minlength=x.n), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FULL.split(", ")])

    return run


def alignments(docs: DataFrame, byte_bpe: str = BYTE_BPE, model: str = pieces.MODEL) -> DataFrame:
    """For each row of docs: ids and ends in bytes of the tokens of both sides, links as places in these, and ends of groups.

    Bytes are counted from the space before the text. A null or empty text, and one whose tokens do not give it back, has
    empty lists. Repeated rows and null ids are aligned like others; an empty table gives none.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_full(load(byte_bpe, model)), _FULL)


def _links(pair: Pair) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair_, part, x in _batches(pair, batches):
            width = len(pair_.pieces)
            all_pairs = len(pair_.size[0]) * width
            la, lb = x.link
            key = x.doc[0][la] * all_pairs + x.ids[0][la] * width + x.ids[1][lb]
            key, times = np.unique(key, return_counts=True)
            doc, code = np.divmod(key, all_pairs)
            counted = np.bincount(doc, minlength=x.n)
            groups = np.bincount(np.searchsorted(x.base, x.common - 1, "right") - 1, minlength=x.n)
            columns = [part.column("row"), part.column("doc_id"), pa.array(np.diff(x.first(0))), pa.array(np.diff(x.first(1))), pa.array(groups), pa.array(np.bincount(x.doc[0][la], minlength=x.n)), pa.array(group_texts(pair_, x))]
            columns += [_lists(v, counted, pa.int32()) for v in (code // width, code % width, times)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _LINKS.split(", ")])

    return run


def _looked_up(code: np.ndarray, n: np.ndarray, best: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("a")
            at = np.asarray(rows.offsets).astype(np.int64)
            a, b, times = (np.asarray(batch.column(c).values)[at[0] : at[-1]].astype(np.int64) for c in ("a", "b", "times"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            wanted = a << 32 | b
            place = np.minimum(np.searchsorted(code, wanted), max(len(code) - 1, 0))
            hit = code[place] == wanted if len(code) else np.zeros(len(wanted), bool)
            total = lambda x: pa.array(np.bincount(owner[hit], x, batch.num_rows).astype(np.int64))  # noqa: E731, B023
            place, counted, rest = place[hit], times[hit], ~hit
            left = np.bincount(owner[rest], minlength=batch.num_rows)
            columns = [*(batch.column(c) for c in _KEPT), total(counted * best[place]), total(counted * n[place]), *(_lists(v[rest], left, pa.int32()) for v in (a, b, times))]
            yield pa.RecordBatch.from_arrays(columns, [*_KEPT, "n_best", "count_sum", "a", "b", "times"])

    return run


def report(docs: DataFrame, byte_bpe: str = BYTE_BPE, model: str = pieces.MODEL, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs.

    An id pair counts once for each row that holds it linked. Counts of the most frequent pairs, `head` at most, travel with
    the tasks; those of all others are joined. Null, empty and unfaithful texts have zeros and ''; repeated rows and null
    ids are documents of their own; an empty table gives none.
    """
    pair = load(byte_bpe, model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    found = stash(rows.mapInArrow(_links(pair), _LINKS), "links")
    counts = found.select(F.explode(F.arrays_zip("a", "b")).alias("z")).groupBy(F.col("z.a").alias("a"), F.col("z.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = stash(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    # The least power of two from which on at most `head` pairs are left: one small count for each power.
    by_power = {r.power: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    least = next(p for p in range(65) if sum(v for k, v in by_power.items() if k >= p) <= head)
    common = judged.where(F.col("n") >= 2**least).select(F.expr("shiftleft(cast(a as long), 32) | b").alias("code"), "n", "best").toArrow()
    code, n, best = (np.asarray(common[c].combine_chunks()) if common.num_rows else np.zeros(0, np.int64) for c in ("code", "n", "best"))
    order = np.argsort(code)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = found.mapInArrow(_looked_up(code[order], n[order], best[order].astype(np.int64)), _LINKS.replace(" a array", " n_best long, count_sum long, a array"))
    if all(k >= least for k in by_power):  # no rarer pairs are left
        return standing_for(out.select(columns), found)
    out = stash(out, "parts")
    discard(found)
    rare = out.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("z")).select("row", "z.*").join(judged.where(F.col("n") < 2**least), ["a", "b"])
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("n"))
    more = lambda name, rest: (F.col(name) + F.coalesce(F.col(rest), F.lit(0))).alias(name)
    joined = out.drop("a", "b", "times").join(rare, "row", "left")
    return joined.select(*columns[:5], more("n_best", "best"), more("count_sum", "n"), columns[-1])
