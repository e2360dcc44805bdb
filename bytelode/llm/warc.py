"""WARC archives: written by the tasks that hold the pages, read back in order, record by record.

Each record is a gzip member of its own. The reader inflates an archive block by block, takes a record's length from its
header, and checks its digests as the bytes go by, so that neither an archive nor, without payloads, a record is ever held
whole. An archive is read by one task; archives are rolled at a size, so their number follows the data.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, standing_for, stash

#: Compressed bytes at which an archive is rolled, and payloads from which on a repeated one is written as a revisit.
ROLL, LEAST = 32 << 20, 100
#: Bytes that are read, and inflated, at a time.
BLOCK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:bytelode:page:"
_MANIFEST = "path string, records long, bytes long"
_RECORD = "path string, offset long, record_type string, record_id string, refers_to string, uri string, block_bytes long, payload_bytes long, payload_digest string, verified boolean, error string"
_LINE = re.compile(rb"\r?\n")


# --- writing -------------------------------------------------------------------------------------------------------------


def _header(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def _uri(url: str | None) -> str | None:
    """A url for a header line: control characters and spaces are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed: a response with its payload, or a revisit that only has the payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + html if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if (uri := _uri(url)) is not None:
        fields.append(("WARC-Target-URI", uri))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _member(_header(fields) + block + b"\r\n\r\n")


def _member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(6, wbits=31)
    return squeeze.compress(raw) + squeeze.flush()


def _info() -> bytes:
    block = b"software: bytelode\r\nformat: WARC File Format 1.1\r\n"
    return _member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n")


def _store(uri: str):  # noqa: ANN202
    """(file system, path) of a folder that driver and executors share; s3a addresses are s3 ones here."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


def _writer(folder: str, roll: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        out, name, size, records = None, "", 0, 0

        def ended() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], [c.split()[0] for c in _MANIFEST.split(", ")])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    # Every attempt at a task has files of its own; only those of the attempt that ends are in the manifest.
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(head := _info())
                    size, records = len(head), 0
                member = record(page_id, url, (html or "").encode(), digest, refers_to)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= roll:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()

    return run


def assigned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest and refers_to: the page whose equal payload a row revisits, or null for a response.

    Of equal payloads of at least `least` bytes the rows with the smallest page_id are responses. A row without page_id
    is a response unless a page has its payload.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    shared = rows.where(F.col("size") >= least).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    joined = rows.join(shared, F.col("digest") == F.col("of"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, roll: int = ROLL, least: int = LEAST) -> DataFrame:
    """Write a record for each page into archives of about `roll` bytes: path, records and bytes of each archive.

    The manifest is itself a table in the shared folder. Archives that it lacks are left from attempts that were lost.
    """
    return stash(assigned(pages, least).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(folder, roll), _MANIFEST), "archives")


# --- reading -------------------------------------------------------------------------------------------------------------


class Fault(ValueError):
    """An archive that breaks its format."""


class Inflated:
    """The bytes of an archive in order, gzip member after gzip member, or as they are in one that is not compressed.

    `member` is where the member began that the next byte is of. At most BLOCK bytes are inflated ahead.
    """

    def __init__(self, raw: BinaryIO, block: int = BLOCK) -> None:
        self.raw, self.block, self.held, self.at = raw, block, b"", 0
        self.rest, self.taken, self.ended = b"", 0, False
        head = raw.read(max(block, 2))
        self.rest = head
        self.plain = head[:2] != b"\x1f\x8b"
        self.inflate = None
        self.member = 0

    def _more(self) -> bool:
        """Add bytes to what is held; false at the end of the archive."""
        while True:
            if not self.rest and not self.ended:
                self.rest = self.raw.read(self.block)
                self.ended = not self.rest
            if self.plain:
                got, self.rest = self.rest, b""
                self.taken += len(got)
            else:
                if self.inflate is None:
                    if not self.rest:
                        return False
                    self.inflate, self.member = zlib.decompressobj(wbits=31), self.taken
                try:
                    got = self.inflate.decompress(self.rest, self.block)
                except zlib.error as e:
                    raise Fault(f"gzip: {e}") from e
                if self.ended and not got and not self.inflate.eof:
                    raise Fault("the archive ends within a gzip member")
                left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
                self.taken += len(self.rest) - len(left)
                self.rest = left
                if self.inflate.eof:
                    self.inflate = None
            if got:
                self.held = self.held[self.at :] + got
                self.at = 0
                return True
            if self.plain or (self.ended and not self.rest and self.inflate is None):
                return False

    def line(self, most: int = 1 << 20) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        start = 0
        while True:
            if found := _LINE.search(self.held, self.at + start):
                out = self.held[self.at : found.start()]
                self.at = found.end()
                return out
            start = max(0, len(self.held) - self.at - 1)
            if start > most:
                raise Fault("a header line without an end")
            if not self._more():
                if self.at < len(self.held):
                    raise Fault("the archive ends within a header")
                return None

    def take(self, size: int) -> Iterator[bytes]:
        """The next bytes, so many in all."""
        while size:
            if self.at == len(self.held) and not self._more():
                raise Fault("the archive ends within a block")
            part = self.held[self.at : self.at + size]
            self.at += len(part)
            size -= len(part)
            yield part


@dataclass
class Record:
    """What a record's header says, and what its bytes gave."""

    offset: int
    fields: dict[str, str]
    block_bytes: int = 0
    payload_bytes: int | None = None
    payload_digest: str | None = None
    verified: bool | None = None
    payload: bytes | None = field(default=None, repr=False)


def _fields(source: Inflated) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case; a line that begins with white space goes on."""
    out: dict[str, str] = {}
    last = None
    while line := source.line():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
        else:
            raise Fault(f"not a header line: {text[:80]}")
    if line is None:
        raise Fault("the archive ends within a header")
    return out


def _digest(said: str | None) -> tuple[str | None, str | None]:
    """(algorithm, value in lower case) of a digest field."""
    kind, _, value = (said or "").partition(":")
    return (kind.strip().lower().replace("-", "") or None, value.strip().lower() or None)


def records(raw: BinaryIO, payloads: bool = False, block: int = BLOCK) -> Iterator[Record]:
    """All records of an archive, in order. An unreadable archive raises Fault after the records before the fault.

    verified is whether the digests that a header gives agree with its block and payload; null where it gives none that
    can be checked. A revisit's block has no payload: its payload's length and digest are those that its headers state.
    """
    source = Inflated(raw, block)
    while True:
        line = source.line()
        while line == b"":  # records end in two empty lines
            line = source.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise Fault(f"not the start of a record: {line[:40]!r}")
        out = Record(source.member if not source.plain else source.taken - len(source.held) + source.at - len(line) - 2, _fields(source))
        try:
            size = int(out.fields["content-length"])
        except (KeyError, ValueError):
            raise Fault("a record without its content-length") from None
        if size < 0:
            raise Fault("a record without its content-length")
        yield _read_block(source, out, size, payloads)


def _read_block(source: Inflated, out: Record, size: int, payloads: bool) -> Record:
    said_block, said_payload = _digest(out.fields.get("warc-block-digest")), _digest(out.fields.get("warc-payload-digest"))
    of_block = hashlib.new(said_block[0]) if said_block[0] in hashlib.algorithms_available else None
    kind = said_payload[0] if said_payload[0] in hashlib.algorithms_available else "sha256"
    of_payload, revisit = hashlib.new(kind), out.fields.get("warc-type") == "revisit"
    http = out.fields.get("content-type", "").startswith("application/http")
    head, in_head, kept, length = b"", http, [], 0
    for part in source.take(size):
        if of_block:
            of_block.update(part)
        if in_head:
            head += part
            end = head.find(b"\r\n\r\n")
            if end < 0 and len(head) <= 1 << 20:
                continue
            part, head, in_head = (head[end + 4 :], head[:end], False) if end >= 0 else (head, b"", False)  # no header after all
        of_payload.update(part)
        length += len(part)
        if payloads:
            kept.append(part)
    out.block_bytes = size
    checks = []
    if of_block:
        checks.append(_same(of_block, said_block[1]))
    if revisit:
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        out.payload_bytes, out.payload_digest = int(stated[1]) if stated else None, said_payload[1]
    else:
        out.payload_bytes, out.payload_digest = length, of_payload.hexdigest()
        if said_payload[0] == kind and said_payload[1]:
            checks.append(_same(of_payload, said_payload[1]))
        out.payload = b"".join(kept) if payloads else None
    out.verified = all(checks) if checks else None
    return out


def _same(found, said: str | None) -> bool:  # noqa: ANN001
    """Digests are written in hexadecimal or in base 32."""
    from base64 import b32encode

    return said in (found.hexdigest(), b32encode(found.digest()).decode().lower().rstrip("="), b32encode(found.digest()).decode().lower())


def _reader(payloads: bool, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in _RECORD.split(", ")] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()] + [pa.binary()] * payloads

    def bare(value: str | None) -> str | None:
        return value and value.strip("<>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                store, at = _store(path)
                try:
                    with store.open_input_stream(at, compression=None) as raw:
                        for r in records(raw, payloads, block):
                            f = r.fields
                            rows.append((path, r.offset, f.get("warc-type"), bare(f.get("warc-record-id")), bare(f.get("warc-refers-to")), f.get("warc-target-uri"), r.block_bytes, r.payload_bytes, r.payload_digest, r.verified, None, *[r.payload] * payloads))
                            held += len(r.payload or b"")
                            if len(rows) >= 5000 or held > 1 << 22:
                                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                                rows, held = [], 0
                except Fault as e:
                    rows.append((path, *[None] * 9, str(e), *[None] * payloads))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read(archives: DataFrame, payloads: bool = False, tasks: int | None = None, block: int = BLOCK) -> DataFrame:
    """The records of archives, given by a column path: one row each, with offset, header, lengths, digest and whether it agrees.

    An archive that breaks its format ends with a row whose error says how; the records before are given. With payloads the
    last column holds them; without, no record is ever held whole. Archives are dealt out to tasks one by one.
    """
    spark = archives.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = archives.select("path").repartition(tasks)
    return dealt.mapInArrow(_reader(payloads, block), _RECORD + ", payload binary" * payloads)


def paths(spark: SparkSession, found: list[str]) -> DataFrame:
    """Archives by their paths, for `read`."""
    return spark.createDataFrame([(p,) for p in found], "path string")


def round_trip(pages: DataFrame, roll: int = ROLL, least: int = LEAST) -> DataFrame:
    """Write pages into archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Null html is an empty payload; null urls have no target; rows without page_id, and repeated rows, have records like others.
    An empty table gives no archive and no row. A record whose digests disagree, or an archive that breaks, fails the query.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write(pages, folder, roll, least)
    found = read(manifest).where("record_type is null or record_type in ('response', 'revisit')")
    number = lambda c: F.expr(f"try_cast(nullif(replace({c}, '{_ID}', ''), '') as bigint)")
    sound = F.when(F.col("error").isNotNull() | ~F.coalesce("verified", F.lit(False)), F.raise_error(F.concat_ws(" ", F.lit("archive"), "path", F.coalesce("error", F.lit("a digest disagrees"))))).otherwise(F.col("verified"))
    return standing_for(found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), sound.cast("boolean").alias("verified")), manifest)


def round_trip_sql(least: int = LEAST) -> str:
    """What the records must say, in DuckDB's SQL."""
    return f"""
with payload as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as size, sha256(coalesce(html, '')) as digest from pages),
placed as (select *, min(page_id) over (partition by html) as first_id, count(*) over (partition by html) as n from payload)
select page_id, size::bigint as payload_bytes, digest as payload_digest, case when revisits then 'revisit' else 'response' end as record_type,
  case when revisits then first_id end as refers_to, true as verified
from (select *, size >= {least} and first_id is not null and (page_id is null or page_id <> first_id) as revisits from placed)"""
