"""Suffix-array dedup: removes every byte that a string of 200 bytes covers which also starts anywhere else.

Only suffixes in q-gram buckets with company can matter, and of those only sampled ones need to travel: every string of
LENGTH bytes names, as its anchor, the q-gram of least hash inside it (the first of equal ones), so equal strings name
equal q-grams at equal offsets. A document's anchors are some 80 bytes apart.

1. Initial buckets: anchors by their q-gram. Anchors whose whole surroundings agree form one class.
2. The surroundings of one anchor for each class in a shared bucket are refined by bucket pointers: every position points
   to the bucket of its first 8 bytes; positions are then sorted on their own bucket and the identifier of the bucket at
   the later offset where their known bytes end, so that each round's updated identifiers serve the next for twice as many
   bytes. Strings alone in their bucket are settled and leave; what shares a bucket of LENGTH bytes is repeated. Nothing is
   hashed in this. A bucket with more than HOT classes is refined in parts; strings settled inside a part are compared
   across parts by hash, in slices that are no larger.
3. The repeated stretches return to all anchors of the class, and each document loses their union.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import discard, pieces, stash, utf8

LENGTH, GRAM, LANE = 200, 32, 8
_REACH = LENGTH - GRAM + 1
#: Classes of a bucket that one task refines together.
HOT = 4096
_BATCH = 2 << 20


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the q-gram that starts at each place."""
    lane, n = kernels.lanes(data).copy(), len(data) - GRAM + 1
    out = np.full(n, GRAM, np.uint64)
    for k in range(0, GRAM, LANE):
        out = kernels.mix((out ^ lane[k : k + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return out


def anchors(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of the texts at[i]..at[i+1]: text, place in it, bucket, class, and the range low..high of offsets at which it stands in its strings.

    The least hash is that of the upper 32 bits, the first of equal ones: a string names the same anchor wherever it stands.
    """
    n = len(data)
    none = {k: np.zeros(0, np.int64) for k in ("text", "place", "bucket", "kind", "low", "high")}
    if n < LENGTH:
        return none
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    starts = np.flatnonzero(left >= LENGTH)
    if not len(starts):
        return none
    grams, bits = _grams(data), np.uint64(32)
    least = (grams >> bits << bits) | np.arange(n - GRAM + 1).astype(np.uint64)
    width = 1
    while 2 * width <= _REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[_REACH - width :][: n - LENGTH + 1])
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    x = anchor[new]
    text = np.searchsorted(at, x, "right") - 1
    high, low = x - first, x - last
    kind = kernels.mix(kernels.spans(data, first, last + LENGTH) + (high * 256 + low).astype(np.uint64))
    return {"text": text, "place": x - at[text], "bucket": grams[x].view(np.int64), "kind": kind.view(np.int64), "low": low, "high": high}


def _pack(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return place << 16 | high << 8 | low


def _anchors_of(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Anchors of a batch, an order by bucket and class, and where each class begins in it."""
    found = [(lo, anchors(data, at)) for lo, _, data, at in pieces(batch.column("text"), 1 << 19)]
    a = {k: np.concatenate([f[k] + (lo if k == "text" else 0) for lo, f in found]) if found else np.zeros(0, np.int64) for k in ("text", "place", "bucket", "kind", "low", "high")}
    order = np.lexsort((a["kind"], a["bucket"]))
    b, k = a["bucket"][order], a["kind"][order]
    new = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])])) if len(order) else np.zeros(0, np.int64)
    return a, order, new


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, kind, row, spot, n): one anchor of each class within a batch, with n as 2 if there were more."""
    for batch in batches:
        rows = np.asarray(batch.column("row"))
        a, order, new = _anchors_of(batch)
        pick, n = order[new], np.minimum(np.diff(np.append(new, len(order))), 2)
        spot = _pack(a["place"], a["low"], a["high"])
        yield pa.RecordBatch.from_arrays([pa.array(a["bucket"][pick]), pa.array(a["kind"][pick]), pa.array(rows[a["text"][pick]]), pa.array(spot[pick]), pa.array(n)], ["bucket", "kind", "row", "spot", "n"])


_CLASS = "bucket long, kind long, row long, spot long, n long"


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class within a batch one row with all the places where it stands: a passage that every document holds is one row for many documents."""
    for batch in batches:
        rows = np.asarray(batch.column("row"))
        a, order, new = _anchors_of(batch)
        if not len(order):
            continue
        pick, cut = order[new], pa.array(np.append(new, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(x[order])) for x in (rows[a["text"]], a["place"])]
        yield pa.RecordBatch.from_arrays([pa.array(a["bucket"][pick]), pa.array(a["kind"][pick]), pa.array(np.full(len(new), rows[0])), *lists], ["bucket", "kind", "batch", "rows", "places"])


_ASK = "bucket long, kind long, batch long, rows array<long>, places array<long>"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the bytes around the wanted anchors out of their texts."""
    before = None
    for batch in batches:
        row = np.asarray(batch.column("row"))
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        new[:1] &= row[:1] != before  # rows that are repeated stand side by side after the join: one is enough
        before = row[-1] if len(row) else before
        batch = batch.filter(pa.array(new))
        data, at, _ = utf8(batch.column("text"))
        wanted = batch.column("wanted")
        cut = np.asarray(wanted.offsets)
        cut, rows = cut - cut[0], wanted.flatten()
        spot = np.asarray(rows.field("spot"))
        start = np.repeat(at[:-1], np.diff(cut)) + (spot >> 16) - (spot >> 8 & 255)
        size = (spot >> 8 & 255) - (spot & 255) + LENGTH
        for lo in range(0, len(spot), 1 << 14):
            hi = min(lo + (1 << 14), len(spot))
            ends = np.concatenate([[0], np.cumsum(size[lo:hi])])
            body = data[np.repeat(start[lo:hi] - ends[:-1], size[lo:hi]) + np.arange(ends[-1])]
            around = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([*(rows.field(k).slice(lo, hi - lo) for k in ("bucket", "kind", "spot", "n", "parts", "part")), around], ["bucket", "kind", "spot", "n", "parts", "part", "around"])


_AROUND = "bucket long, kind long, spot long, n long, parts long, part long, around binary"


def strings(spot: np.ndarray, around: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all surroundings, and for each string of each class its class, its start and its anchor's offset."""
    data, at, _ = utf8(around)
    data, at = data[at[0] : at[-1]], at - at[0]
    high, low = spot >> 8 & 255, spot & 255
    count = high - low + 1
    owner = np.repeat(np.arange(len(spot)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return data, owner, at[:-1][owner] + k, high[owner] - k


def _company(bucket: np.ndarray) -> np.ndarray:
    """Which items are not alone in their bucket."""
    _, where, n = np.unique(bucket, return_inverse=True, return_counts=True)
    return n[where] > 1


def refine(bucket: np.ndarray, data: np.ndarray, owner: np.ndarray, start: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Which strings have an equal one in another class of their bucket. Strings of one class stand at different offsets and so are unequal."""
    out = np.zeros(len(owner), bool)
    if not len(owner):
        return out
    lane = kernels.lanes(data)
    ends = kernels.mix(kernels.mix(lane[start] + np.uint64(1)) ^ lane[start + LENGTH - LANE])
    alive = np.flatnonzero(_company(kernels.mix(bucket.view(np.uint64)[owner] + offset.astype(np.uint64)) ^ ends))
    if not len(alive):
        return out
    # Positions that the strings left cover; what is known of one, from it on, must not reach past its stretch.
    first, last = start[alive], start[alive] + LENGTH
    new = np.flatnonzero(np.concatenate([[True], (owner[alive][1:] != owner[alive][:-1]) | (first[1:] > last[:-1])]))
    low, high = first[new], last[np.append(new[1:], len(alive)) - 1]
    size = high - low
    ends = np.cumsum(size)
    at = np.repeat(low - (ends - size), size) + np.arange(ends[-1])
    left = np.repeat(ends, size) - np.arange(ends[-1])
    place = first - np.repeat(low - (ends - size), np.diff(np.append(new, len(alive))))
    here = np.flatnonzero(left >= LANE)
    pointer = np.zeros(len(at), np.uint64)
    pointer[here] = np.unique(lane[at[here]], return_inverse=True)[1]
    reach = LANE
    while reach < LENGTH:
        step = min(reach, LENGTH - reach)
        here = here[left[here] >= reach + step]
        pointer[here] = np.unique(pointer[here] << np.uint64(32) | pointer[here + step], return_inverse=True)[1]
        reach += step
    out[alive[_company(pointer[place])]] = True
    return out


def _names(data: np.ndarray, start: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Hashes by which strings of one bucket are compared across its parts."""
    return kernels.mix(kernels.spans(data, start, start + LENGTH) + offset.astype(np.uint64))


def stretches(n: int, owner: np.ndarray, offset: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n classes, as a flat list with n + 1 cuts: from and to, from the anchor on, of the runs of repeated strings."""
    first, last = repeated.copy(), repeated.copy()
    first[1:] &= ~repeated[:-1] | (owner[1:] != owner[:-1])
    last[:-1] &= ~repeated[1:] | (owner[1:] != owner[:-1])
    flat = np.stack([-offset[first], LENGTH - offset[last]], 1).ravel()
    return flat, np.concatenate([[0], np.cumsum(2 * np.bincount(owner[first], minlength=n))])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = _BATCH) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that never cut a group of equal keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.nbytes
        if n < size:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        change = np.zeros(whole.num_rows, bool)
        for key in keys:
            column = np.asarray(whole.column(key))
            change[1:] |= column[1:] != column[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
        n = held[0].nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _once(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of rows sorted by bucket and kind one for each class: a repeated row of the table brings its classes again."""
    bucket, kind = np.asarray(rows.column("bucket")), np.asarray(rows.column("kind"))
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (bucket[1:] != bucket[:-1])
    return rows if new.all() else rows.filter(pa.array(new))


_FOUND = "bucket long, kind long, spans array<int>"


def _answers(rows: pa.RecordBatch, owner: np.ndarray, offset: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """Repeated stretches of the classes; those of a class that is itself repeated are known already."""
    flat, cuts = stretches(rows.num_rows, owner, offset, repeated)
    spans = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(flat, pa.int32()))
    found = (np.diff(cuts) > 0) & (np.asarray(rows.column("n")) == 1)
    return pa.RecordBatch.from_arrays([rows.column("bucket"), rows.column("kind"), spans], ["bucket", "kind", "spans"]).filter(pa.array(found))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of all classes of whole buckets."""
    for batch in _groups(batches, ["bucket"]):
        batch = _once(batch)
        data, owner, start, offset = strings(np.asarray(batch.column("spot")), batch.column("around"))
        yield _answers(batch, owner, offset, refine(np.asarray(batch.column("bucket")), data, owner, start, offset))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Every (bucket, part) group of a batch, with its bucket and part."""
    bucket, part = np.asarray(batch.column("bucket")), np.asarray(batch.column("part"))
    cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]), [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield batch.slice(a, b - a), int(bucket[a]), int(part[a])


_SLICE = "bucket long, part long, slice long, names binary, twice binary"


def _offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of a large bucket, its distinct strings' names, sorted into as many slices as there are parts."""
    for batch in _groups(batches, ["bucket", "part"]):
        for rows, bucket, part in _parts(batch):
            rows = _once(rows)
            data, _, start, offset = strings(np.asarray(rows.column("spot")), rows.column("around"))
            names, n = np.unique(_names(data, start, offset), return_counts=True)
            parts = int(rows.column("parts")[0].as_py())
            to = (kernels.mix(names) % np.uint64(parts)).astype(np.int64)
            out = [(bucket, part, k, names[to == k].tobytes(), (n[to == k] > 1).tobytes()) for k in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [x.split()[0] for x in _SLICE.split(", ")])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice, for each part the names that are repeated."""
    for batch in _groups(batches, ["bucket", "slice"]):
        renamed = batch.rename_columns(["bucket", "from", "part", "names", "twice"])
        for rows, bucket, at in _parts(renamed):
            names = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("names")]
            twice = [np.frombuffer(x.as_py(), bool) for x in rows.column("twice")]
            value, where, n = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
            often = n > 1
            often[where[np.concatenate(twice)]] = True
            out = [(bucket, int(p.as_py()), at, x[often[np.searchsorted(value, x)]].tobytes(), b"") for p, x in zip(rows.column("from"), names, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [x.split()[0] for x in _SLICE.split(", ")])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of the classes of one part, given the part's repeated names."""
    for batch in _groups(batches, ["bucket", "part"]):
        for rows, _, _ in _parts(batch):
            is_class = np.asarray(rows.column("kind").is_valid())
            names = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in rows.filter(pa.array(~is_class)).column("names"))]))
            rows = _once(rows.filter(pa.array(is_class)))
            data, owner, start, offset = strings(np.asarray(rows.column("spot")), rows.column("around"))
            mine = _names(data, start, offset)
            at = np.minimum(np.searchsorted(names, mine), max(len(names) - 1, 0))
            yield _answers(rows, owner, offset, names[at] == mine if len(names) else np.zeros(len(mine), bool))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Union of (from, to) ranges, as maximal runs in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]], 1)


def kept_bytes(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    if not len(spans):
        return text, 0, 0
    runs = _merged(spans)
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), int((runs[:, 1] - runs[:, 0]).sum()), len(runs)


def _each(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int]]:
    for text, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("spans"), strict=True):
        flat = np.asarray(spans.values) if spans.is_valid else np.zeros(0, np.int64)
        yield kept_bytes(text.as_py() or b"", flat.reshape(-1, 2))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text").cast(pa.large_binary())]
        rows = [(removed, runs, hashlib.sha256(left).hexdigest()) for left, removed, runs in _each(batch)]
        removed, runs, digest = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # a repeated string may begin or end inside a character; what remains of such a character goes, too
        left = [k.decode("utf-8", "ignore") if runs else t.as_py() for t, (k, _, runs) in zip(batch.column("text"), _each(batch), strict=True)]
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if n == "text" else c for n, c in rest], [n for n, _ in rest])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the answers to each batch of documents, for every document the union of its repeated stretches."""
    for batch in _groups(batches, ["batch"]):
        rows, places, spans = (batch.column(k) for k in ("rows", "places", "spans"))
        n_rows, n_spans = np.diff(np.asarray(rows.offsets)), np.diff(np.asarray(spans.offsets)) // 2
        row, place = rows.flatten().to_numpy(), places.flatten().to_numpy()
        flat = spans.flatten().to_numpy().reshape(-1, 2).astype(np.int64)
        each = np.repeat(n_spans, n_rows)  # ranges at each place
        first = np.repeat(np.cumsum(n_spans) - n_spans, n_rows)
        of = np.repeat(np.arange(len(row)), each)
        k = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(len(of))
        names, doc = np.unique(row[of], return_inverse=True)
        far = doc.astype(np.int64) << 40  # documents one after the other, so that one union serves all
        runs = _merged(np.stack([far + place[of] + flat[k, 0], far + place[of] + flat[k, 1]], 1)) if len(of) else np.zeros((0, 2), np.int64)
        cut = np.searchsorted(runs[:, 0] >> 40, np.arange(len(names) + 1))
        ranges = pa.array((runs & ((1 << 40) - 1)).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays((2 * cut).astype(np.int32), ranges)], ["row", "spans"])


def _with_spans(docs: DataFrame, hot: int) -> DataFrame:
    """docs (of doc_id, text and others) with the ranges of bytes to remove (array<long>: from, to, from, to, ...; null if none)."""
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    texts = keyed.select("row", "text")
    long = texts.where(F.octet_length("text") >= LENGTH)
    classes = long.mapInArrow(_classes, _CLASS).groupBy("bucket", "kind").agg(F.sum("n").alias("n"), F.min(F.struct("row", "spot")).alias("one"))
    shared = classes.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("total > 1").drop("total")
    parts = F.expr(f"(k + {hot - 1}) div {hot}")
    classes = classes.join(shared, "bucket").select("bucket", "kind", "n", "one.row", "one.spot", "k", parts.alias("parts"), F.pmod("kind", parts).alias("part"))
    classes = stash(classes.where("n > 1 or k > 1"), "classes")

    wanted = classes.where("k > 1").groupBy("row").agg(F.collect_list(F.struct("bucket", "kind", "spot", "n", "parts", "part")).alias("wanted"))
    around = stash(long.join(wanted, "row").select("row", "text", "wanted").mapInArrow(_surroundings, _AROUND), "surroundings")
    found = around.where("parts = 1").repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_settle, _FOUND)
    large = around.where("parts > 1")
    if large.limit(1).count():
        offers = large.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind").mapInArrow(_offer, _SLICE)
        met = offers.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice").mapInArrow(_meet, _SLICE)
        both = large.select("bucket", "part", "kind", "spot", "n", "around", F.lit(None).cast("binary").alias("names")).unionAll(met.select("bucket", "part", F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("binary"), "names"))
        found = found.unionAll(both.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind").mapInArrow(_answer, _FOUND))
    whole = F.expr(f"array(int(-(shiftright(spot, 8) & 255)), int({LENGTH} - (spot & 255)))")
    spans = stash(classes.where("n > 1").select("bucket", "kind", whole.alias("spans")).unionAll(found), "spans")
    discard(classes, around)

    answers = long.mapInArrow(_asks, _ASK).join(spans, ["bucket", "kind"]).select("batch", "rows", "places", "spans")
    removed = answers.repartition("batch").sortWithinPartitions("batch").mapInArrow(_gather, "row long, spans array<long>").dropDuplicates(["row"])
    removed = stash(removed, "removed")
    discard(spans)
    return keyed.join(removed, "row", "left").drop("row")


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs.

    Null and empty texts have no bytes, and texts under LENGTH bytes lose none. A repeated row is another place where its
    strings start, so both lose all such bytes.
    """
    out = _with_spans(docs.select(F.col("doc_id").cast("long"), "text"), hot)
    return out.select("doc_id", "text", "spans").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs, with all their columns, without the repeated bytes of text; a character that loses a byte goes as a whole."""
    names = docs.columns
    plain = docs.toDF(*(n if n in ("doc_id", "text") else f"c{k}" for k, n in enumerate(names)))  # no name can clash with those used here
    return _with_spans(plain, hot).mapInArrow(_rewrite, plain.schema).toDF(*names)
