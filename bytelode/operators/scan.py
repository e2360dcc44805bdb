"""Header hits of all specs in chunks of bytes, with the facts that sizes and checks are then computed from as columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.functions import walkers as W
from bytelode.functions.bytesx import WILDCARD, matches, piece
from bytelode.sources.scratch import shared_path
from bytelode.sources.store import store

from .signatures import Signatures, together
from .signatures import printable as printable
from .specs import Spec

HEAD = 64
SCAN = "struct<width: int, height: int, broken: long, restarts: boolean, status: string>"
#: The facts of a hit that its chunk has no footer for, seen on the whole image up to the longest size.
LATE = "struct<rem: long, footer_at: long, marker_end: long, head: binary, sound: boolean>"
HIT = f"image_id string, chunk_no int, chunk_offset long, spec_idx int, pos long, pass_no int, k1 long, k2 long, rem long, footer_at long, marker_end long, head binary, probe_at long, probe binary, walked long, sound boolean, scan {SCAN}, late {LATE}"
_NAMES = [x.split()[0] for x in HIT.split(f", scan {SCAN}")[0].split(", ")] + ["scan", "late"]
_SCAN_TYPE = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("broken", pa.int64()), ("restarts", pa.bool_()), ("status", pa.string())])
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), _SCAN_TYPE, pa.struct([("rem", pa.int64()), ("footer_at", pa.int64()), ("marker_end", pa.int64()), ("head", pa.binary()), ("sound", pa.bool_())])]
#: Types whose size never depends on bytes beyond the chunk.
WITHIN = ("jpeg", "vjpeg", "zip", "pdf")
_ROWS = 1000
#: Characters of text patterns that travel to the driver and the tasks at once; more are searched for in several passes.
PATTERN_CHARS = 4_000_000


@lru_cache(512)
def pattern(value: bytes, case_sensitive: bool) -> re.Pattern:
    """A byte pattern in which ? fits any byte; case folds for ASCII letters only."""
    return re.compile(b"".join(b"." if c == WILDCARD else re.escape(bytes([c])) for c in value), re.DOTALL | (0 if case_sensitive else re.IGNORECASE))


def find(data: bytes, value: bytes, start: int = 0, case_sensitive: bool = True) -> int | None:
    """Leftmost match at or after start; an empty pattern is at start."""
    if case_sensitive and WILDCARD not in value:
        at = data.find(value, start)
        return at if at >= 0 else None
    m = pattern(value, case_sensitive).search(data, start)
    return m.start() if m else None


def find_last(data: bytes, value: bytes, case_sensitive: bool = True) -> int | None:
    """Rightmost match."""
    at, start = None, 0
    if case_sensitive and WILDCARD not in value:
        at = data.rfind(value)
        return at if at >= 0 else None
    while (got := find(data, value, start, case_sensitive)) is not None:
        at, start = got, got + 1
    return at


def positions(data: bytes, spec: Spec, quick_block: int = 0) -> list[int]:
    """All places of a spec's header, overlapping ones too: at block boundaries only in quick mode; within printable bytes for Ascii; from the end for Reverse."""
    found = Signatures([spec]).places(data, quick_block).get(0, [])
    return [int(k) for k in (found[::-1] if spec.search_type == "Reverse" and not quick_block else found)]


class _Next:
    """The first place of a pattern at or after ascending positions, found in one pass over the data."""

    def __init__(self, data: bytes, value: bytes, case_sensitive: bool = True) -> None:
        self.data, self.value, self.case, self.at = data, value, case_sensitive, -1

    def after(self, start: int) -> int | None:
        if self.at is not None and (self.at < start):
            self.at = find(self.data, self.value, start, self.case)
        return self.at


class _Shared:
    """What hits of several specs look for in the same data, found when first asked for."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    zip = cached_property(lambda self: W.zip_ends(self.data))
    pdf = cached_property(lambda self: W.PdfMarks(self.data))
    jpeg = cached_property(lambda self: W.JpegMarks(self.data))
    mov = cached_property(lambda self: W.MovMarks(self.data))


class _Chunk:
    """A chunk as the ascending hits of one spec see it: what several of them would look for again is found once, and nothing is copied for a hit but its head."""

    def __init__(self, shared: _Shared, spec: Spec) -> None:
        self.shared, self.data, self.spec, self.kind = shared, shared.data, spec, spec.kind
        self.footer = _Next(self.data, spec.footer, spec.case_sensitive) if spec.footer else None
        self.markers = [_Next(self.data, m) for m in spec.markers]
        self.end = _Next(self.data, _ENDS[self.kind]) if self.kind in _ENDS else None

    def facts(self, pos: int) -> tuple:
        data, shared, kind, longest = self.data, self.shared, self.kind, self.spec.max_len
        rem = len(data) - pos
        at = self.footer.after(pos) if self.footer else None
        footer_at = None if at is None else at - pos
        ends = [m + len(x.value) - pos for x in self.markers if (m := x.after(pos)) is not None] if self.markers else ()
        head, probe_at, probe, walked, sound, scan = data[pos : pos + HEAD], None, None, None, None, None
        end, plain = self.end.after(pos) if self.end else None, min(longest, rem)
        if kind == "exe" and rem >= 64:
            probe_at = W.number(head, 0x3C, 4)
            probe = data[pos + probe_at : pos + probe_at + 84] if probe_at + 4 <= rem else None
        elif kind == "zip" and end is not None and end <= len(data) - 22:
            probe_at, probe = end - pos, data[end : end + 22]
        elif kind == "zip":
            walked = W.zip_by_headers(data, longest, pos, shared.zip)
        elif kind == "pdf":
            walked = W.pdf_size(data, longest, pos, shared.pdf)
        elif kind == "jpeg":
            s = W.jpeg(data, longest, pos, shared.jpeg)
            walked = W.jpeg_size(s, data, longest, pos, shared.jpeg)
            scan = {"width": s.width, "height": s.height, "broken": s.broken, "restarts": s.restarts, "status": s.status}
        elif kind == "mpg":
            walked = plain if end is None else min(end + 4 - pos, longest)
        elif kind == "mov":
            walked = W.mov_size(data, longest, pos)
            sound = W.mov_valid(data, pos, min(len(data), pos + self._length(footer_at, plain, walked)), shared.mov)
        elif kind == "gzip":
            fields = data[pos : pos + W.GZIP_HEAD]
            walked = 0 if rem < 18 else rem if _gzip_valid(fields, rem) else min(W.FALLBACK, plain)
            size = min(self._length(footer_at, plain, walked), rem)
            sound = _gzip_valid(fields[:size], size)
            if may_wait(self.spec) and footer_at is None:
                probe_at = gzip_body(fields, rem < W.GZIP_HEAD)
                probe = fields if probe_at is None else None
        return rem, footer_at, min(ends, default=None), head, probe_at, probe, walked, sound, scan

    def _length(self, footer_at: int | None, plain: int, walked: int) -> int:
        return walked if not self.spec.footer else plain if footer_at is None else footer_at + len(self.spec.footer)

    def late(self, start: int, near: tuple) -> dict | None:
        """What the image, of which this is all, says of a hit whose chunk has no footer for it; None where that isn't asked."""
        spec, data = self.spec, self.data
        if not waits(spec, near):
            return None
        rem = min(len(data) - start, spec.max_len)
        within = lambda x: m - start if (m := x.after(start)) is not None and m + len(x.value) - start <= rem else None
        footer_at = within(self.footer)
        ends = [m + len(x.value) for x in self.markers if (m := within(x)) is not None]
        size = rem if footer_at is None else footer_at + len(spec.footer)
        if self.kind == "mov":
            sound = W.mov_valid(data, start, start + size, self.shared.mov)
        else:
            sound = self.kind == "gzip" and _gzip_valid(data[start : start + min(size, W.GZIP_HEAD)], size)
        return {"rem": rem, "footer_at": footer_at, "marker_end": min(ends, default=None), "head": data[start : start + min(HEAD, rem)], "sound": sound}


#: What ends a file of a kind, wherever that is.
_ENDS = {"zip": b"PK\x05\x06", "mpg": b"\x00\x00\x01\xb9"}


def may_wait(spec: Spec) -> bool:
    """Whether hits of a spec are measured beyond their chunk where that has no footer for them."""
    return bool(spec.footer) and spec.kind not in WITHIN


def waits(spec: Spec, near: tuple) -> bool:
    return may_wait(spec) and near[1] is None and near[0] < spec.max_len


def _gzip_valid(fields: bytes, size: int) -> bool:
    start = W.gzip_header_end(fields)
    return start is not None and W.gzip_payload_valid(fields, start, size)


def gzip_body(fields: bytes, cut: bool) -> int | None:
    """Where the compressed data of a gzip file may start, -1 where it can't be one; None if fields are cut too early to tell."""
    at = W.gzip_header_end(fields)
    if cut and (at is None or at + 5 > len(fields)):
        return None
    return at if at is not None and W.gzip_payload_valid(fields, at, at + 9) else -1


def chunk_hits(data: bytes, specs: list[Spec] | Signatures, quick_block: int = 0, offset: int = 0, image: _Shared | None = None, places: dict[int, list[int]] | None = None) -> Iterator[tuple]:
    """Rows of HIT after chunk_offset, for one chunk, spec by spec and ascending; late facts if the image is given that the chunk starts in at offset.

    places: where headers stand in the chunk, if that is known.
    """
    signatures = specs if isinstance(specs, Signatures) else Signatures(specs)
    near = image if image is not None and image.data is data else _Shared(data)
    for idx, found in (signatures.places_of([data], quick_block)[0] if places is None else places).items():
        spec = signatures.specs[idx]
        literal, backward = spec.literal and not quick_block, spec.search_type == "Reverse" and not quick_block
        chunk, whole = _Chunk(near, spec), None
        for n, pos in enumerate(found):
            facts = chunk.facts(pos)
            order = (0, pos + len(spec.header), idx) if literal else (1, idx, len(found) - n if backward else n)
            late = None
            if image is not None and waits(spec, facts):
                whole = whole or _Chunk(image, spec)
                late = whole.late(offset + pos, facts)
            yield idx, pos, *order, *facts, late


def _run(specs: list[Spec], quick_block: int, ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def start() -> Callable[[pa.RecordBatch], Iterator[tuple]]:
        signatures = Signatures(specs)

        def pieces(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple]]:
            names = zip(*(batch.column(k).to_pylist() for k in ("image_id", "chunk_no", "chunk_offset")), strict=True)
            for name, data in zip(names, batch.column("bytes"), strict=True):
                yield data.as_py() or b"", name

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for group in together(pieces(batch)):
                for (body, name), places in zip(group, signatures.places_of([p for p, _ in group], quick_block), strict=True):
                    if ends:
                        yield from ((*name, *end) for end in chunk_ends(body, specs))
                    for hit in chunk_hits(body, signatures, quick_block, places=places):
                        yield *name, *hit

        return rows

    return _batched(start)


def _run_images(specs: list[Spec], quick_block: int, chunk_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def start() -> Callable[[pa.RecordBatch], Iterator[tuple]]:
        signatures = Signatures(specs)

        def pieces(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple]]:
            for name, content in zip(batch.column("image_id").to_pylist(), batch.column("content"), strict=True):
                image = content.as_py() or b""
                whole = _Shared(image)
                for no, offset in enumerate(range(0, len(image), chunk_size)):
                    yield image[offset : offset + chunk_size], (name, no, offset, whole)

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for group in together(pieces(batch)):
                for (body, (name, no, offset, whole)), places in zip(group, signatures.places_of([p for p, _ in group], quick_block), strict=True):
                    for hit in chunk_hits(body, signatures, quick_block, offset, whole, places):
                        yield name, no, offset, *hit

        return rows

    return _batched(start)


def _batched(start: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of HIT in batches of some _ROWS, whatever the batches that they come from; start makes what a task needs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = start()
        held: list[tuple] = []
        for batch in batches:
            for row in rows(batch):
                held.append(row)
                if len(held) == _ROWS:
                    yield _batch(held)
                    held = []
        yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def hits(chunks: DataFrame, specs: list[Spec], quick_block: int = 0, ends: bool = False) -> DataFrame:
    """Every header hit in chunks (image_id, chunk_no, chunk_offset, bytes), those of a spec in a chunk side by side and ascending.

    The bytes stay in this stage; of a file only its first HEAD bytes go on. With ends each chunk's rows of `chunk_ends`
    come before its hits.
    """
    return chunks.select("image_id", "chunk_no", "chunk_offset", "bytes").mapInArrow(_run(specs, quick_block, ends), HIT)


#: pass_no of the rows that say what a chunk holds for hits of chunks before it.
ENDS = -1


def lead(specs: list[Spec]) -> int:
    """How many bytes of a chunk's start and end its neighbours must know: to see heads, footers and markers that lie across."""
    return max([HEAD, *(len(x) for s in specs if may_wait(s) for x in (s.footer, *s.markers))])


def chunk_ends(data: bytes, specs: list[Spec]) -> Iterator[tuple]:
    """What hits of other chunks must know of one chunk, as rows of HIT after chunk_offset whose pass_no is ENDS.

    One row (spec_idx -1) has its length as pos, its first bytes as head and its last ones as probe; and one for each spec
    that may wait has the places of its first footer and of the first end of a marker.
    """
    size, columns = lead(specs), _NAMES[3:]
    first = max(size, W.GZIP_HEAD if any(may_wait(s) and s.file_type.lower() == "gzip" for s in specs) else 0)
    row = lambda **known: tuple(known.get(c) for c in columns)
    yield row(spec_idx=-1, pos=len(data), pass_no=ENDS, head=data[:first], probe=data[max(0, len(data) - size) :])
    for idx, spec in enumerate(specs):
        if may_wait(spec):
            ends = [at + len(m) for m in spec.markers if (at := find(data, m)) is not None]
            yield row(spec_idx=idx, pos=0, pass_no=ENDS, footer_at=find(data, spec.footer, 0, spec.case_sensitive), marker_end=min(ends, default=None))


def image_hits(images: DataFrame, specs: list[Spec], chunk_size: int, quick_block: int = 0) -> DataFrame:
    """As `hits` over the chunks of whole images, and while an image is at hand what lies beyond the chunk of a hit without a footer (late)."""
    return images.select("image_id", "content").mapInArrow(_run_images(specs, quick_block, chunk_size), HIT)


def _counted(patterns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ahocorasick.Automaton()
        for n, value in enumerate(patterns):
            search.add_word(value, (n, len(value)))
        search.make_automaton()
        for batch in batches:
            found: Counter[int] = Counter()
            for text in batch.column("text"):
                ends: dict[int, int] = {}
                for end, (n, size) in search.iter(text.as_py() or ""):
                    if end - size >= ends.get(n, -1):
                        ends[n] = end
                        found[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array([patterns[n] for n in found], pa.string()), pa.array(found.values(), pa.int64())], ["pattern", "n_hits"])

    return run


def occurrences(texts: DataFrame, patterns: DataFrame, chars: int = PATTERN_CHARS) -> DataFrame:
    """pattern and n_hits for each pattern (column pattern) that stands in any text (column text): whole and unchanged, places of one pattern not overlapping.

    Patterns go to the tasks in blocks of about `chars` characters, dealt by their hash; each block is one pass over the
    texts. Null and empty patterns are nowhere.
    """
    wanted = patterns.where("pattern <> ''").select("pattern").distinct()
    total = wanted.agg(F.sum(F.length("pattern"))).first()[0] or 0
    blocks = 1 + total // chars
    out = None
    for k in range(blocks):
        some = [r[0] for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()]
        if some:
            part = texts.select("text").mapInArrow(_counted(some), "pattern string, n_hits long")
            out = part if out is None else out.unionAll(part)
    if out is None:
        return wanted.select("pattern", F.lit(0).cast("long").alias("n_hits"))
    return out.groupBy("pattern").agg(F.sum("n_hits").alias("n_hits"))


def _tally(specs: list[Spec] | str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _counters(specs) if isinstance(specs, str) else Counters(specs, range(len(specs)))
        for batch in batches:
            found = search.count(data.as_py() or b"" for data in batch.column("bytes"))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["spec_idx", "n_hits"])

    return run


class Counters:
    """How often each header of a catalog stands in bytes: plain ones by one automaton, whose time does not grow with the catalog, others by `Signatures`."""

    def __init__(self, specs: list[Spec], numbers: Iterable[int]) -> None:
        rest, alike = [], {}
        for spec, number in zip(specs, numbers, strict=True):
            if spec.literal and spec.search_type != "Ascii":
                alike.setdefault(spec.header.decode("latin-1"), []).append(int(number))
            else:
                rest.append((spec, int(number)))
        self.numbers = list(alike.values())
        self.search = ahocorasick.Automaton()
        for n, header in enumerate(alike):
            self.search.add_word(header, n)
        self.search.make_automaton()
        self.rest, self.of_rest = Signatures([s for s, _ in rest]) if rest else None, [n for _, n in rest]

    def count(self, pieces: Iterable[bytes]) -> dict[int, int]:
        found, plain = Counter(), [0] * len(self.numbers)
        for group in together((p, ()) for p in pieces):
            if plain:
                for piece, _ in group:
                    for _, n in self.search.iter(piece.decode("latin-1")):
                        plain[n] += 1
            if self.rest is not None:
                for places in self.rest.places_of([p for p, _ in group]):
                    for k, at in places.items():
                        found[self.of_rest[k]] += len(at)
        for numbers, times in zip(self.numbers, plain, strict=True):
            for number in numbers if times else ():
                found[number] += times
        return found


def tally(chunks: DataFrame, specs: list[Spec] | DataFrame) -> DataFrame:
    """spec_idx and n_hits: how often each header that is met stands in chunks (column bytes), in one pass for all of the catalog.

    Specs may be a table (specs.SCHEMA), which the tasks read from the shared folder. Counts leave a task, not places.
    """
    if isinstance(specs, DataFrame):
        specs = _written(specs)
    return chunks.select("bytes").mapInArrow(_tally(specs), "spec_idx int, n_hits long").groupBy("spec_idx").agg(F.sum("n_hits").alias("n_hits"))


#: For the process of a task, the catalog table that it has read last, as places are looked for in it and as they are counted.
_catalogs: dict[str, Signatures] = {}
_counts: dict[str, Counters] = {}


def _read(table: str) -> tuple[list[Spec], list[int]]:
    """The headers of a catalog table (specs.SCHEMA) and their numbers, read where the task runs."""
    system, at = store(table)
    rows = ds.dataset(at, format="parquet", filesystem=system).to_table(columns=["spec_idx", "suffix", "header", "case_sensitive", "search_type"]).to_pylist()
    rows.sort(key=lambda r: r["spec_idx"])
    return [Spec("Config", r["suffix"], r["header"], None, 0, r["case_sensitive"], r["search_type"]) for r in rows], [r["spec_idx"] for r in rows]


def _signatures(table: str) -> Signatures:
    if table not in _catalogs:
        specs, numbers = _read(table)
        found = Signatures(specs)
        found.idx = np.array(numbers, np.int32)
        _catalogs.clear()
        _catalogs[table] = found
    return _catalogs[table]


def _counters(table: str) -> Counters:
    if table not in _counts:
        _counts.clear()
        _counts[table] = Counters(*_read(table))
    return _counts[table]


class SignatureHits:
    """The handler of the table function signature_hits(bytes, catalog): spec_idx and pos of every header of the catalog table in the bytes."""

    def eval(self, data: bytes, catalog: str) -> Iterator[tuple[int, int]]:
        found = _signatures(catalog)
        for k, at in found.places(data or b"").items():
            idx = int(found.idx[k])
            for pos in at.tolist():
                yield idx, pos


def register_signature_hits(spark: SparkSession) -> None:
    """Make signature_hits known to SQL: `select ... from chunks, lateral signature_hits(bytes, '<path of a catalog table>')`."""
    spark.udtf.register("signature_hits", F.udtf(SignatureHits, returnType="spec_idx int, pos long"))


def _written(catalog: DataFrame) -> str:
    table = shared_path(catalog.sparkSession, "catalog")
    catalog.select("spec_idx", "suffix", "header", "case_sensitive", "search_type").write.parquet(table)
    return table


def places(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """chunks (all columns but bytes) with spec_idx and pos of every header of a catalog, a table of any length, that stands in them.

    The catalog (specs.SCHEMA) is written to the shared folder and read by the tasks: it is neither in the plan nor on the driver.
    """
    spark = chunks.sparkSession
    register_signature_hits(spark)
    table = _written(catalog)
    names = ", ".join(f"c.`{n}`" for n in chunks.columns if n != "bytes")
    return spark.sql(f"select {names}, h.spec_idx, h.pos from {{chunks}} c, lateral signature_hits(c.bytes, {{table}}) h", chunks=chunks, table=table)


def block_hits(data: Column, header: bytes, block_size: int, case_sensitive: bool = True) -> Column:
    """Quick mode for one spec, as an array of places: block boundaries at which the header stands."""
    n = len(header)
    last = F.octet_length(data) - n
    steps = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(block_size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.filter(steps, lambda k: matches(piece(data, k, n), header, 0, not case_sensitive))
