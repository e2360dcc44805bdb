"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

An item of length n may differ by n // SLACK edits. Cut into one piece more than that, at least one piece must stand
unchanged in any passage close enough; all pieces are searched for in one pass, and around each hit the exact distance
is computed with Myers' bit vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an item for each edit allowed.
SLACK = 20
#: Characters of items that travel to the tasks at once; a larger benchmark is searched for in several passes.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, and one space for each run of white space."""
    return " ".join(text.lower().split())


def budget(item: str) -> int:
    return len(item) // SLACK


def cut(item: str) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length and where each starts."""
    parts = budget(item) + 1
    edges = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def least_distance(item: str, text: str, most: int) -> int | None:
    """The least edit distance between item and any substring of text, if it is no more than most (Myers, 1999)."""
    n = len(item)
    where: dict[str, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for c in text:
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up, down = up << 1 & full, down << 1 & full  # a passage may start anywhere: the first row stays 0
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return best if best <= most else None


class Finder:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.items = [(k, t) for k, t in ((k, normal(t)) for k, t in items if t is not None) if t]
        uses: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            for start, piece in cut(text):
                uses.setdefault(piece, []).append((n, start))
        self.search = ahocorasick.Automaton()
        for piece, use in uses.items():
            self.search.add_word(piece, (len(piece), use))
        self.search.make_automaton()
        self.any = bool(uses)

    def find(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item_id, distance) for each item that text holds."""
        if not self.any or not text:
            return []
        text = normal(text)
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.search.iter(text):
            for n, start in uses:
                item = self.items[n][1]
                lo = end + 1 - size - start - budget(item)
                hi = lo + len(item) + 2 * budget(item)
                spans = near.setdefault(n, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        out = []
        for n, spans in near.items():
            key, item = self.items[n]
            found = [d for lo, hi in spans if (d := least_distance(item, text[max(0, lo) : max(0, hi)], budget(item))) is not None]
            if found:
                out.append((key, min(found)))
        return out


def _pairs(items: list[tuple[int | None, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items)
        for batch in batches:
            found = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for x in finder.find(t.as_py())]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["doc_id", "item_id", "distance"])

    return run


def _clean(items: list[tuple[int | None, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items)
        for batch in batches:
            yield batch.filter(pa.array([not finder.find(t.as_py()) for t in batch.column("text")], pa.bool_()))

    return run


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about `chars` characters, dealt by a hash of their text; empty and null texts go."""
    items = benchmark.where("length(trim(text)) > 0").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // chars
    for k in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id and distance for each document that holds a passage within an item's budget; distance is the least.

    Case and the kind of white space don't count. Null and empty texts hold nothing, empty items are nowhere, and an item
    shorter than SLACK must stand there exactly. Repeated rows, of either table, give repeated pairs.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for items in blocks(benchmark, chars):
        part = rows.mapInArrow(_pairs(items), "doc_id long, item_id long, distance int")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    for items in blocks(benchmark, chars):
        docs = docs.mapInArrow(_clean(items), docs.schema)
    return docs
