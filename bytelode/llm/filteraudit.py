"""Filter interaction audit: what each of five filters removes under every order in which they can be applied.

Four filters look at a text alone; the fifth asks whether a smaller doc_id has the same text anywhere in the table. Tasks
insert the texts that they read into a compressed radix trie whose terminals hold the smallest id, so a task passes on one
row for each different text. These go by ranges of text prefixes, made longer wherever one holds too much, to the tasks
that insert them into the final tries and flag duplicates as they traverse them. What is left of a document is a mask of
five bits; everything else is sums over masks.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import discard, pieces, stash

FILTERS = "ABCDE"
#: Bytes of text that a trie holds before it is traversed and emptied (one text may be longer).
TRIE_BYTES = 32 << 20
#: Different texts that the prefixes are taken from, for each range, and the first length of a prefix; it doubles where needed.
SAMPLE, PREFIX = 16, 16
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
_SMALL = "doc_id long, part string, mask int, n long"
_LOCAL = f"{_SMALL}, range int, text binary"


class Trie:
    """A compressed radix trie: an edge holds a stretch of bytes, a terminal the smallest id that came with its text and the rows that still wait there."""

    __slots__ = ("edges", "smallest", "rows")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Trie]] = {}
        self.smallest: int | None = None
        self.rows: dict[tuple, int] | None = None

    def terminal(self, text: bytes) -> Trie:
        """The node that a text ends in, made where it lacks."""
        node, at, size = self, 0, len(text)
        while at < size:
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Trie()
                node.edges[text[at]] = text[at:] if at else text, leaf
                return leaf
            label, below = edge
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            same = _agree(label, text, at)
            between = Trie()
            between.edges[label[same]] = label[same:], below
            node.edges[text[at]] = label[:same], between
            node, at = between, at + same
        return node

    def insert(self, text: bytes, doc_id: int | None, *row: object) -> None:
        """A row without an id waits at its text's terminal, but is smaller than none. Rows alike wait as one, counted."""
        node = self.terminal(text)
        if node.rows is None:
            node.rows = {}
        *what, n = row
        key = (doc_id, *what)
        node.rows[key] = node.rows.get(key, 0) + n
        if doc_id is not None and (node.smallest is None or doc_id < node.smallest):
            node.smallest = doc_id

    def traverse(self) -> Iterator[tuple[bytes, bool, tuple, int]]:
        """Every waiting row with its text: whether a smaller id has the text too, the row, and how often it came."""
        left: list[tuple[Trie, tuple]] = [(self, ())]
        while left:
            node, path = left.pop()
            if node.rows is not None:
                text = b"".join(_unwound(path))
                for row, n in node.rows.items():
                    yield text, node.smallest is not None and row[0] is not None and row[0] > node.smallest, row, n
            left += [(below, (path, label)) for label, below in node.edges.values()]


def _unwound(path: tuple) -> list[bytes]:
    out = []
    while path:
        path, label = path
        out.append(label)
    return out[::-1]


def _agree(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of label stand at text[at:]: doubled steps, then halved ones."""
    lo, hi = 0, min(len(label), len(text) - at)
    step = 16
    while lo + step < hi and label[lo : lo + step] == text[at + lo : at + lo + step]:
        lo += step
        step *= 2
    hi = min(hi, lo + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == text[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def masks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    n = len(at) - 1
    raw = data.tobytes()
    words, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n):
        seen: set[bytes] = set()
        lo, stop = int(at[k]), int(at[k + 1])
        while lo < stop:  # a long text goes in stretches that end at a separator
            cut = _SEPARATOR.search(raw, lo + (1 << 20), stop)
            hi = cut.start() if cut else stop
            found = raw[lo:hi].split()
            words[k] += len(found)
            seen.update(found)
            lo = hi
        distinct[k] = len(seen)
    upper = kernels.counts((data >= 65) & (data <= 90), at)
    chars = kernels.counts((data & 0xC0) != 0x80, at)
    marks = np.zeros(256, bool)
    marks[list(b"#$%&*|")] = True
    failed = words < 200, 100 * distinct < 50 * words, 100 * upper > 2 * chars, kernels.counts(marks[data], at) > 0
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _local(bounds: list[bytes], ranges: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Mask the texts of a task and insert them: what a smaller id of the trie repeats goes on as a mask, the rest with its text."""

    def emptied(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, twice, (doc_id, part, mask), n in trie.traverse():
            if twice:
                rows.append((doc_id, part, mask | 16, n, doc_id % ranges, None))
            else:
                rows.append((doc_id, part, mask, n, bisect_right(bounds, text), text))
                size += len(text)
            if size > 1 << 21 or len(rows) >= 10_000:
                yield _table(rows, _LOCAL)
                rows, size = [], 0
        yield _table(rows, _LOCAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = Trie(), 0
        for batch in batches:
            doc_ids, parts = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            for lo, hi, data, at in pieces(batch.column("text")):
                mask, raw, at = masks(data, at).tolist(), data.tobytes(), at.tolist()
                for k in range(hi - lo):
                    trie.insert(raw[at[k] : at[k + 1]], doc_ids[lo + k], parts[lo + k], mask[k], 1)
                held += at[-1]
                if held > most:
                    yield from emptied(trie)
                    trie, held = Trie(), 0
        yield from emptied(trie)

    return run


def _final(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Insert the texts of a range, which come in order, so that a full trie can be emptied as soon as a new text comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, last = Trie(), 0, None

        def emptied() -> pa.RecordBatch:
            return _table([(doc_id, part, mask | 16 * twice, n) for _, twice, (doc_id, part, mask), n in trie.traverse()], _SMALL)

        for batch in batches:
            text = batch.column("text")
            done = text.is_null()
            yield batch.select([x.split()[0] for x in _SMALL.split(", ")]).filter(done)
            rest = batch.filter(pc.invert(done))
            for doc_id, part, mask, n, one in zip(*(rest.column(c).to_pylist() for c in ("doc_id", "part", "mask", "n", "text")), strict=True):
                if held > most and one != last:
                    yield emptied()
                    trie, held = Trie(), 0
                trie.insert(one, doc_id, part, mask, n)
                held += len(one) if one != last else 0
                last = one
        yield emptied()

    return run


def prefixes(texts: DataFrame, ranges: int, sample: int = SAMPLE, length: int = PREFIX) -> list[bytes]:
    """Bounds of at most `ranges` ranges of texts that hold about as many different texts each, in bytewise order.

    They come from a sample of about `sample` different texts a range, taken by hash. A prefix that more of them share is
    doubled in length until it parts them, so copies with small changes late in long texts are parted too. The driver gets
    prefixes and counts of the sample, never texts.
    """
    few = sample * ranges
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    different = texts.select(F.approx_count_distinct("text")).first()[0]
    hashed = texts.select(F.xxhash64("text").alias("h"), text)
    if different > few:
        hashed = hashed.where(F.pmod("h", F.lit(1 << 32)) < int(few / different * (1 << 32)))
    found = stash(hashed.groupBy("h").agg(F.first("text").alias("text")).select("text"), "prefixes")
    counted: dict[bytes, int] = {}
    heavy: list[bytes] | None = None
    while heavy is None or heavy:
        some = found
        if heavy:
            short = texts.sparkSession.createDataFrame([(bytearray(p),) for p in heavy], "p binary")
            some = found.join(F.broadcast(short), F.substring("text", 1, length // 2) == F.col("p"), "left_semi")
        rows = {bytes(r.p): r.n for r in some.groupBy(F.substring("text", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        heavy = [p for p, n in rows.items() if n > sample and len(p) == length]
        counted |= {p: n for p, n in rows.items() if n <= sample or len(p) < length}
        length *= 2
    discard(found)
    share, gathered, bounds = max(1.0, sum(counted.values()) / ranges), 0, []
    for p in sorted(counted):
        if gathered >= share * (len(bounds) + 1):
            bounds.append(p)
        gathered += counted[p]
    return bounds


def flags(docs: DataFrame, most: int = TRIE_BYTES) -> DataFrame:
    """doc_id, part, mask and n: how many rows of that id and part fail just the filters whose bits the mask has.

    A row without doc_id repeats nothing and is repeated by nothing; rows that share the smallest id of a text repeat nothing.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = prefixes(docs, ranges)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(_local(bounds, ranges, most), _LOCAL)
    return rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("text").mapInArrow(_final(most), _SMALL)


def _orders() -> Column:
    """Every step of every order: its filter's bit, and those of the filters before it."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [{"filter_order": "".join(o), "step": k + 1, "own": bit[o[k]], "before": sum(bit[f] for f in o[:k])} for o in permutations(FILTERS) for k in range(len(o))]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string, step:int, own:int, before:int>>")


def reduce(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit from masks: one row for each part, order and step. Of several labels of a document any 1 counts."""
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    # Rows without an id get keys of their own, lest they all meet in one task, and are kept from matching by `real`.
    rows = masks.select("part", "mask", "n", F.coalesce("doc_id", F.monotonically_increasing_id()).alias("key"), F.col("doc_id").isNotNull().alias("real"))
    rows = rows.join(marked.withColumn("real", F.lit(True)), ["key", "real"], "left")
    labelled = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    sums = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), labelled("good").alias("good"), labelled("bad").alias("bad"))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("z")).select("part", "z", F.explode(_orders()).alias("o")).select("part", "z", "o.*")

    def total(holds: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x["n"]) -> Column:
        return F.aggregate("z", F.lit(0).cast("long"), lambda so_far, x: so_far + F.when(holds(x["mask"]), value(x)).otherwise(F.lit(0)).cast("long"))

    own, before = F.col("own"), F.col("before")
    fails, alive = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) == 0)
    removed = lambda m: fails(m) & alive(m)
    return parts.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & ~alive(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(removed, lambda x: x["good"]).alias("good_lost"),
        total(removed, lambda x: x["bad"]).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders
        total(fails, lambda x: x["n"] * F.lit(factorial(len(FILTERS))) / F.bit_count(x["mask"])).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, most: int = TRIE_BYTES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    Null texts are empty, null sources the part ''. Repeated rows count each. Without documents there are no parts and no rows.
    """
    return reduce(flags(docs, most), labels)


def audit_sql() -> str:
    """The same in DuckDB's SQL."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    bits = " + ".join(f"(case when {c} then {1 << k} else 0 end)" for k, c in enumerate(["n_words < 200", "100 * n_distinct < 50 * n_words", "100 * n_upper > 2 * n_chars", "marked", "doc_id > first_id"]))
    return f"""
with word as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, {words} as words from documents),
stats as (
  select doc_id, part, len(words) as n_words, len(list_distinct(words)) as n_distinct, length(text) as n_chars, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
    regexp_matches(text, '[#$%&*|]') as marked, min(doc_id) over (partition by text) as first_id from word),
label as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
masks as (
  select part, {bits} as mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(bad, 0)) as bad from stats left join label using (doc_id) group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)),
orders as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, s as step, bits[s] as own, coalesce(list_sum(bits[1:s - 1]), 0)::int as before from orders, (select unnest([1, 2, 3, 4, 5]) as s))
select part, filter_order, step::int as step,
  sum(case when mask & (own | before) = 0 then n else 0 end)::bigint as kept,
  sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end)::bigint as removed,
  sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant,
  sum(case when mask = own then n else 0 end)::bigint as unique_fails,
  sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
  sum(case when mask & own <> 0 and mask & before = 0 then bad else 0 end)::bigint as toxic_lost,
  sum(case when mask & own <> 0 then n * 120 // bit_count(mask) else 0 end)::bigint as shapley
from masks, steps group by part, filter_order, step, own, before"""
