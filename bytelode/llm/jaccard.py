"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed into blocks of parity bits: each shingle flips one bit. Two sketches differ in
no more bits than the sets have elements that aren't common. Sets of a, b elements with a Jaccard similarity of 0.9 or
more differ by at most (a + b) / 19 elements; so of one block more than that, at least one block is equal. The rows of
bits are so wide (64-bit indexes) that a block is kept as the XOR of its bits' numbers.

Two unlike sets can share blocks that are empty in both. So bands have some more blocks than the bound asks for: a set
that fills more blocks than may differ needs only its filled ones, since one of these must be equal; the few sets that
fill less meet each other in empty blocks, too. Sizes fall into bands, each with a number of blocks that suits its
largest sets; a set also enters the next band if a set there could be similar to it.

Nodes are distinct sets, known by a 64-bit hash, so exact copies never meet as pairs. The members of a bucket are tied to
one leader (within a batch, then over all batches: no bucket is gathered anywhere). Ties are held against two bounds, that
of sizes and that of a second sketch with two bits or more for each element, and then verified on the whole sets: first the
tie of each node to the leader with which it shares most blocks. Where a bucket's members are not all in one component
by then, they are held against further leaders, and in the end all its pairs across components that both bounds leave are
verified. So no link that the definition knows can be missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import discard, pieces, stash
from .components import components

#: Ratio of the largest to the least size of a band.
BAND = 1.5
#: Elements for each word of 64 bits of the second sketch, and its least words.
SPARSE, LEAST_WORDS = 32, 16
#: Further leaders that the members of a bucket with a failed tie are held against before all its pairs are.
LEADERS = 4
#: Keys that a task sorts at once, and rows that it sends on at once.
_KEYS, _SENT = 1 << 19, 1 << 16
#: More than the bands there are: a key's low bits say which band it is of.
_BANDS = 64
_TIE = "key long, node long, leader long, spare int"


class Bands:
    """Size bands for a similarity of percent / 100: up to `first` elements, only equal sets are that similar."""

    def __init__(self, percent: int = 90) -> None:
        self.percent = percent
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.may_differ: list[int] = []
        self.blocks: list[int] = []
        hi = 0
        while self.difference(2 * (hi + 1)) < 1:
            hi += 1
        self.first = hi
        while hi < 1 << 30:
            lo = hi + 1
            hi = max(int(lo * BAND), lo)
            while self.difference(2 * (hi + 1)) == self.difference(2 * lo):
                hi += 1
            self.lo.append(lo)
            self.hi.append(hi)
            self.may_differ.append(self.difference(2 * hi))
            self.blocks.append(self._enough(self.may_differ[-1], -(-lo * percent // 100)))
        self.least = np.array([-(-lo * percent // 100) for lo in self.lo])  # the smallest set that one of size lo may be similar to
        self.most = np.array(self.hi)

    @staticmethod
    def _enough(may_differ: int, least: int) -> int:
        """So many blocks that nearly every set of at least `least` elements fills more than may_differ of them."""
        blocks = float(may_differ + 1)
        while blocks < 4 * (may_differ + 1):
            empty = math.exp(-least / blocks)
            if blocks * (1 - empty) - 3 * math.sqrt(blocks * empty) >= may_differ + 1:
                break
            blocks = blocks * 1.02 + 1
        return int(blocks)

    def difference(self, total: int) -> int:
        """How many elements two similar sets of `total` elements together may not have in common."""
        return total * (100 - self.percent) // (100 + self.percent)


def shingles(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text; A-Z count as a-z, a shorter text is one shingle."""
    data = kernels.LOWER[data]
    start, end, first = kernels.words(data, at)
    hashes = kernels.spans(data, start, end)
    owner = kernels.owners(first)
    grams, where = kernels.windows(hashes, first, words)
    who, what = [owner[where]], [grams]
    n = np.diff(first)
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        whole = np.zeros(len(short), np.uint64)
        for i in range(k):
            whole = kernels.mix(whole + hashes[first[short] + i] * np.uint64(2 * k + 1) + np.uint64(i))
        who.append(short)
        what.append(whole)
    return kernels.distinct(np.concatenate(who), np.concatenate(what))


def _sums(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by owner, owners in order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    at = np.searchsorted(owner, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def set_hashes(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A hash of each of n sets."""
    size = np.bincount(owner, minlength=n).astype(np.uint64)
    return kernels.mix(_sums(owner, kernels.mix(value ^ np.uint64(11)), n) + size).view(np.int64)


def sketches(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The second sketches of n sets, one after the other, and n + 1 offsets: a power of two of words each, which folds to half of it."""
    size = np.bincount(owner, minlength=n)
    wide = 1 << np.ceil(np.log2(np.maximum(size / SPARSE, LEAST_WORDS))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(wide)])
    h = kernels.mix(value ^ np.uint64(29))
    words = np.zeros(int(at[-1]), np.uint64)
    place = at[:-1][owner] + ((h >> np.uint64(32)).astype(np.int64) & (wide[owner] - 1))
    np.bitwise_xor.at(words, place, np.uint64(1) << (h & np.uint64(63)))
    return words.view(np.int64), at


def blocks(owner: np.ndarray, value: np.ndarray, n: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the blocks of n sets, one after the other, whose low bits are the band, and n + 1 offsets; then, for
    each set and band that it enters, the set, the band and how many keys it can spare.

    A set that fills f blocks, more than the d that may differ, shares at least f - d of its keys with any similar one.
    So of all sets' keys, put in one order, the last f - d - 1 of each set may be left out: what is left still meets.
    """
    size = np.bincount(owner, minlength=n)
    at = np.searchsorted(owner, np.arange(n + 1))
    low, high = np.searchsorted(bands.most, size), np.searchsorted(bands.least, size, "right")
    entries = np.where(size > bands.first, np.maximum(high - low, 0), np.maximum(high, 0) * (size > 0))
    low = np.where(size > bands.first, low, 0)
    text = np.repeat(np.arange(n), entries)
    band = np.repeat(low, entries) + np.arange(len(text)) - np.repeat(np.cumsum(entries) - entries, entries)
    count = np.array(bands.blocks)[band] if len(band) else np.zeros(0, np.int64)
    base = np.concatenate([[0], np.cumsum(count)])
    sizes = size[text]
    of = np.repeat(np.arange(len(text)), sizes)
    pick = np.repeat(at[text], sizes) + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = kernels.mix(value[pick] + np.repeat(band.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), sizes))
    block = (((h >> np.uint64(32)) * count[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    content, filled = np.zeros(int(base[-1]), np.uint64), np.zeros(int(base[-1]), bool)
    np.bitwise_xor.at(content, base[of] + block, kernels.mix(h ^ np.uint64(5)))
    filled[base[of] + block] = True
    entry = np.repeat(np.arange(len(text)), count)
    over = np.bincount(entry, filled, len(text)).astype(np.int64) - np.array(bands.may_differ)[band] if len(band) else np.zeros(0, np.int64)
    enough = over > 0
    number = np.arange(len(content)) - base[entry]
    key = kernels.mix(kernels.mix(content + filled.astype(np.uint64)) + number.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + band[entry].astype(np.uint64))
    key = key & ~np.uint64(_BANDS - 1) | band[entry].astype(np.uint64)
    emit = filled | ~enough[entry]
    return key[emit].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(text[entry[emit]], minlength=n))]), text, band, np.maximum(over - 1, 0)


def _describe(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in pieces(batch.column("text")):
                owner, value = shingles(data, at, words)
                sketch, cut = sketches(owner, value, hi - lo)
                columns = [pa.array(np.bincount(owner, minlength=hi - lo)), pa.array(set_hashes(owner, value, hi - lo)), pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(sketch))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], ["doc_id", "n", "node", "sketch"])

    return run


def _ties(key: pa.Array, node: pa.Array, leader: pa.Array | None = None, spare: pa.Array | None = None) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(key), kind)
    return pa.RecordBatch.from_arrays([key, node, none(pa.int64()) if leader is None else leader, none(pa.int32()) if spare is None else spare], ["key", "node", "leader", "spare"])


def _led(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each bucket one row without a leader; for its other members rows with the leader they are tied to."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] = ~new[1:] & (node[1:] == node[:-1])
    leader = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else node
    rows = _ties(pa.array(key[~again]), pa.array(node[~again]), pa.array(leader[~again], mask=new[~again]))
    for lo in range(0, rows.num_rows, _SENT):
        yield rows.slice(lo, _SENT)


def _by_batch(words: int, bands: Bands) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Buckets' members, tied to leaders among some hundred texts at a time; a set that the task has met before is left out.

    Rows with `spare` say for a node and a band (as key) how many keys it can spare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for lo, hi, data, at in pieces(batch.column("text")):
                owner, value = shingles(data, at, words)
                name = set_hashes(owner, value, hi - lo)
                first = np.zeros(hi - lo, bool)
                first[np.unique(name, return_index=True)[1]] = True
                first &= ~np.isin(name, met)
                met = np.union1d(met, name[first])
                some = first[owner]
                place = np.cumsum(first) - 1
                keys, cut, of, band, spare = blocks(place[owner[some]], value[some], int(first.sum()), bands)
                yield _ties(pa.array(band.astype(np.int64)), pa.array(name[first][of]), None, pa.array(spare.astype(np.int32)))
                held.append((keys, np.repeat(name[first], np.diff(cut))))
                if sum(len(k) for k, _ in held) >= _KEYS:
                    yield from _led(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield from _led(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and node, ties of all nodes without a leader to the first of their bucket; only that one is remembered."""
    key_before, leader_before = None, 0
    for batch in batches:
        done = np.asarray(batch.column("leader").is_valid()) | np.asarray(batch.column("spare").is_valid())
        yield batch.filter(pa.array(done))
        free = pa.array(~done)
        key, node = (np.asarray(batch.column(k).filter(free)) for k in ("key", "node"))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        leader = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if key[0] == key_before:
            leader = np.where(key == key[0], leader_before, leader)
        key_before, leader_before = key[-1], leader[-1]
        tied = node != leader
        yield _ties(pa.array(key[tied]), pa.array(node[tied]), pa.array(leader[tied]))


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sets of texts that are the wanted ones; other texts may bear the same doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in pieces(batch.column("text")):
                owner, value = shingles(data, at, words)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                node = batch.column("node").slice(lo, hi - lo)
                same = pa.array(np.asarray(node) == set_hashes(owner, value, hi - lo))
                yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(cut, pa.array(value.view(np.int64)))], ["node", "items"]).filter(same)

    return run


def _folded(x: Column, to: Column) -> Column:
    """Sketch x, folded once if it is wider than sketch `to`; sizes that may be similar differ by less than two folds."""
    half = (F.size(x) / 2).cast("int")
    return F.when(F.size(x) > F.size(to), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(x)


def _near(m: Callable[[str], Column], o: Callable[[str], Column], percent: int) -> Column:
    """Whether two nodes may be similar enough: sizes and second sketches bound the symmetric difference from below."""
    fits = lambda differ: differ * (100 + percent) <= (m("n") + o("n")) * (100 - percent)
    bits = F.zip_with(_folded(m("sketch"), o("sketch")), _folded(o("sketch"), m("sketch")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(fits(F.abs(m("n") - o("n"))), fits(F.aggregate(bits, F.lit(0), lambda a, x: a + x).cast("long"))).otherwise(False)


def _of(alias: str) -> Callable[[str], Column]:
    return lambda name: F.col(f"{alias}.{name}")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes the linked ones: those that no bound excludes, by the whole sets of one document each."""
    near = pairs.join(nodes.alias("m").withColumnRenamed("node", "a"), "a").join(nodes.alias("o").withColumnRenamed("node", "b"), "b")
    near = stash(near.where(_near(_of("m"), _of("o"), percent)).select("a", "b"), "near")
    if not near.limit(1).count():
        return near
    wanted = near.select(F.col("a").alias("node")).unionAll(near.select("b")).distinct().join(nodes.select("node", "doc_id"), "node")
    sets = docs.join(wanted, "doc_id").select("node", "text").mapInArrow(_sets(words), "node long, items array<long>").dropDuplicates(["node"])
    left, right = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    out = stash(near.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"), "verified")
    discard(near)
    return out


def _near_leaders(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a > b) of members of a bucket with some of it, the first under each of several hashes: a few rows for each member, or less.

    Where ties to one leader failed, most members that are linked to any come together by these, and few pairs remain.
    """
    first = [F.min_by("node", F.xxhash64("node", F.lit(seed))) for seed in range(LEADERS)]
    chosen = members.groupBy("key").agg(F.array_distinct(F.array(*first)).alias("first")).select("key", F.explode("first").alias("node"))
    leaders = members.join(chosen, ["key", "node"]).groupBy("key").agg(F.collect_list(F.struct("node", "root", "n", "sketch")).alias("leaders"))
    close = F.filter("leaders", lambda o: (F.col("root") != o["root"]) & _near(F.col, lambda name: o[name], percent))
    pairs = members.join(leaders, "key").select("node", F.explode(F.transform(close, lambda o: o["node"])).alias("o"))
    return pairs.select(F.greatest("node", "o").alias("a"), F.least("node", "o").alias("b")).distinct()


def _rooted(nodes: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """nodes with the root of the component that column `node` is in, itself if no edge touches it."""
    return nodes.join(roots.select(F.col("node").alias(node), F.col("root").alias("_r")), node, "left").withColumn(root, F.coalesce("_r", node)).drop("_r")


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; what they are made from goes."""
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links))
    discard(roots, links)
    return out


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n and node of each row; node, least doc_id and root of each node) as scratch tables; rows without a word have n = 0 and no node of theirs."""
    bands = Bands(percent)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = stash(docs.mapInArrow(_describe(words), "doc_id long, n long, node long, sketch array<long>"), "rows")
    nodes = stash(rows.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "nodes")
    about = stash(rows.drop("sketch"), "about")
    discard(rows)

    # Rows without doc_id are links of nothing: as leaders, they would keep the others of their buckets apart.
    # Those that are tied already need not meet the rest of their bucket, so they are dealt out evenly.
    local = docs.where("doc_id is not null").mapInArrow(_by_batch(words, bands), _TIE)
    dealt = local.repartition(F.when(F.col("leader").isNull() & F.col("spare").isNull(), F.col("key")).otherwise(F.xxhash64("key", "node")))
    tied = stash(dealt.sortWithinPartitions("key", "node").mapInArrow(_over_batches, _TIE), "ties")
    ties = tied.where("spare is null").select("key", "node", "leader")
    spare = tied.where("spare > 0").groupBy("node", F.col("key").alias("band")).agg(F.max("spare").alias("spare"))

    pairs = stash(ties.groupBy("node", "leader").agg(F.count("*").alias("shared")), "pairs")
    best = pairs.groupBy("node").agg(F.max_by("leader", F.struct("shared", "leader")).alias("b")).select(F.col("node").alias("a"), "b")
    links = _verified(best, docs, nodes, words, percent)
    roots = components(links)
    discard(links)

    # Buckets that are not within one component: members are held against further leaders, then every pair across components is.
    apart = _rooted(_rooted(pairs, roots), roots, "leader", "other").where("root <> other").select("node", "leader")
    doubtful = ties.join(apart, ["node", "leader"]).select("key").distinct()
    members = ties.join(doubtful, "key")
    members = members.select("key", "node").unionAll(members.select("key", "leader")).distinct().withColumn("band", F.col("key").bitwiseAND(F.lit(_BANDS - 1)))
    # Two sets that are not in one component yet share doubtful buckets only. Of those each set spares the largest: what
    # many unlike sets have in common, a passage or a phrase, fills a few blocks of each and so brings few of them together.
    members = stash(members, "members")
    size = members.groupBy("key").agg(F.count("*").alias("size"))
    largest = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("size"), "key"))
    ranked = members.join(size, "key").withColumn("k", largest).join(spare, ["node", "band"], "left")
    every, members = members, stash(ranked.where("k > coalesce(spare, 0)").select("key", "node"), "members")
    discard(tied, pairs, every)
    for last in (False, True):
        if not members.limit(1).count():
            break
        rooted = _rooted(members, roots)
        if last:
            # The commonest component of a bucket is not held against itself, and a bucket within one component is done.
            main = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
            known = stash(rooted.join(main, "key").join(nodes.drop("doc_id"), "node"), "known")
            near = known.alias("m").join(known.where("root <> main").alias("o"), F.expr("m.key = o.key and m.root <> o.root and (m.root = m.main or m.node < o.node)") & _near(_of("m"), _of("o"), percent))
            near = near.select(F.greatest("m.node", "o.node").alias("a"), F.least("m.node", "o.node").alias("b")).distinct()
        else:
            known = stash(rooted.join(nodes.drop("doc_id"), "node"), "known")
            near = _near_leaders(known, percent)
        near = stash(near, "candidates")
        discard(known)
        roots = _grown(roots, _verified(near, docs, nodes, words, percent))
        discard(near)
    named = stash(_rooted(nodes.select("node", "doc_id"), roots), "named")
    discard(members, roots, nodes)
    return about, named


def join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs.

    Texts are linked when their shingle sets have a Jaccard similarity of percent / 100 or more; component_id is the
    least doc_id that links reach. Null, empty and blank texts have no shingles and are linked with nothing. Rows of
    equal sets are linked, repeated rows too; rows without doc_id only share the component of an equal set, if it has an id. Sets are known
    by 64-bit hashes of 64-bit hashes of their shingles: over n distinct sets the odds of any mistake are n*n / 2**65.
    """
    about, named = _linked(docs, words, percent)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "root").select("node", "component_id")
    alone = about.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = stash(about.where("n > 0").join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(alone), "components")
    discard(about, named)
    return out


def join_sql(words: int = 3, percent: int = 90) -> str:
    """The same in DuckDB SQL, on the shingles themselves."""
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(list_slice(w, i, i + {words - 1}), ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p where 100 * i >= {percent} * (na + nb - i)),
r as (select doc_id as a, doc_id as c from documents union select l.b, r.c from r join l on l.a = r.a)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.c) as component_id from s join r on r.a = s.doc_id group by s.doc_id, len(s.s)"""


def _nodes(words: int, text: str, schema: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with two more columns: the size and the hash of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in pieces(batch.column(text)):
                owner, value = shingles(data, at, words)
                own = [pa.array(np.bincount(owner, minlength=hi - lo)), pa.array(set_hashes(owner, value, hi - lo))]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *own], schema)

    return run


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their components: of each the row of least doc_id.

    Texts without words and rows without doc_id all stay. A row is known by its doc_id and its set, so a text whose
    doc_id another, dropped text bears, too, stays if it stands for a component of its own. Of rows of equal doc_id and
    set the one of least text stays.
    """
    about, named = _linked(docs, words, percent)
    first = named.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    first = named.join(first, "root").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.node").alias("first_node"))
    stays = F.coalesce((F.col("doc_id") == F.col("first_id")) & (F.col("node") == F.col("first_node")), F.lit(True))
    judged = about.where("doc_id is not null and n > 0").join(first, "node").select("doc_id", "node", stays.alias("stays"))
    judged = judged.unionAll(about.where("doc_id is not null and n = 0").select("doc_id", "node", F.lit(True)))
    judged = stash(judged, "judged")
    verdict = judged.groupBy("doc_id").agg((F.count("*") > 1).alias("several"), F.bool_and("stays").alias("stays"))
    verdict = stash(verdict.where("several or not stays").select("doc_id", "several"), "verdict")
    discard(about, named)
    kept = docs.join(verdict.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    several = verdict.where("several")
    if not several.limit(1).count():
        discard(judged)
        return kept
    names = docs.columns
    plain = [f"c{k}" for k in range(len(names))]
    key, text = plain[names.index("doc_id")], plain[names.index("text")]
    rows = docs.join(several.select("doc_id"), "doc_id", "left_semi").select(*names).toDF(*plain)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n long, node long"
    rows = rows.mapInArrow(_nodes(words, text, [*plain, "n", "node"]), schema)
    good = judged.where("stays").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("good_id"), F.col("node").alias("good_node"))
    blank, rows = rows.where("n = 0"), rows.where("n > 0").join(good, F.expr(f"{key} = good_id and node = good_node"), "left_semi")
    order = Window.partitionBy(key, "node").orderBy(text, F.hash(*plain))
    rows = rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k").unionAll(blank)
    return kept.unionAll(rows.select(*plain).toDF(*names))
