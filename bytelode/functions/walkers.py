"""Small byte walkers for formats whose structure no column expression follows. `rem` is what stands from a header on."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property
from typing import NamedTuple

import numpy as np

FALLBACK = 64 << 10


class Scan(NamedTuple):
    """What the structure of a JPEG says: where its end marker or else the first impossible byte pair is."""

    width: int | None = None
    height: int | None = None
    end: int | None = None
    broken: int | None = None
    restarts: bool = False

    @property
    def status(self) -> str:
        return "complete" if self.end is not None else "fragmented" if self.broken is not None else "truncated"


def number(data: bytes, at: int, n: int, order: str = "little") -> int:
    """Unsigned integer of n bytes; 0 where data is too short."""
    return int.from_bytes(data[at : at + n], order) if at + n <= len(data) else 0


#: Data of fewer bytes is looked through byte by byte: arrays of so few cost more to make.
SHORT = 4096


class JpegMarks:
    """What the scans of several JPEGs look for in the same data, found once: markers, and where chains of segments lead."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.chains: dict[int, tuple[int, int, bool, frozenset, tuple]] = {}
        if len(data) < SHORT:
            self.ends, self.restarts, self.broken = [], [], []
            at = data.find(0xFF)
            while 0 <= at < len(data) - 1:
                if 0xD0 <= (second := data[at + 1]) <= 0xD7:
                    self.restarts.append(at)
                elif second:
                    self.broken.append(at)
                    if second == 0xD9:
                        self.ends.append(at)
                at = data.find(0xFF, at + 1)
            return
        values = np.frombuffer(data, np.uint8)
        ff = np.flatnonzero(values[:-1] == 0xFF)
        second = values[ff + 1] if len(ff) else ff
        restart = (second >= 0xD0) & (second <= 0xD7)
        self.ends, self.restarts, self.broken = (ff[x].tolist() for x in (second == 0xD9, restart, (second != 0) & ~restart))

    @staticmethod
    def first(places: list[int], start: int, stop: int) -> int | None:
        """The first of the places from start on whose two bytes end at stop or before."""
        k = bisect_left(places, start)
        return places[k] if k < len(places) and places[k] + 2 <= stop else None

    def walk(self, at: int, limit: int) -> tuple[int, bool, frozenset, tuple]:
        """Follow segments from at: where they end, whether in a scan, the kinds met, and the last dimensions.

        No segment starts beyond limit. Chains that meet go on alike, so every 64th place of one is remembered, with what follows.
        """
        last, *rest = self._chain(at, len(self.data))
        return tuple(rest) if last + 2 <= limit else self._chain(at, limit)[1:]

    def _chain(self, at: int, limit: int) -> tuple[int, int, bool, frozenset, tuple]:
        data, n, keep = self.data, len(self.data), limit == len(self.data)
        steps: list[tuple[int, int, tuple]] = []
        last, scan, seen, tail = at, False, frozenset(), (None, None)
        while at + 2 <= limit and data[at] == 0xFF:
            if keep and (known := self.chains.get(at)):
                last, at, scan, seen, tail = known
                break
            last, kind, size = at, data[at + 1], (None, None)
            length = data[at + 2] << 8 | data[at + 3] if at + 4 <= n else 0
            if kind in (0xFF, 0xD8):
                step = 1 if kind == 0xFF else 2
            elif kind in (0xD9, 0xDA) or length < 2 or at + 2 + length > n:
                scan = kind == 0xDA
                at += 2 + (length if scan and length >= 2 else 0)
                break
            else:
                if 0xC0 <= kind <= 0xC2 and at + 9 <= n:
                    h, w = data[at + 5] << 8 | data[at + 6], data[at + 7] << 8 | data[at + 8]
                    size = (w, h) if w and h else size
                step = 2 + length
            steps.append((at, kind, size))
            at += step
        for k in range(len(steps) - 1, -1, -1):
            place, kind, size = steps[k]
            if kind not in seen and kind not in (0xFF, 0xD8):
                seen = seen | {kind}
            tail = tail if tail[0] else size
            if keep and k % 64 == 0:
                self.chains[place] = last, at, scan, seen, tail
        return last, at, scan, seen, tail


def jpeg(data: bytes, max_len: int, start: int = 0, marks: JpegMarks | None = None) -> Scan:
    """Follow the segments from start to the scan data, and that to its end marker or to a marker that can't stand there.

    Places count from start. marks: those of all of data, where several JPEGs are looked for.
    """
    marks, limit = marks or JpegMarks(data), min(start + max_len, len(data))
    end = lambda at: None if (found := marks.first(marks.ends, at, limit)) is None else found - start
    if len(data) - start < 10:
        return Scan(end=end(start))
    if data[start : start + 3] != b"\xff\xd8\xff":
        return Scan()
    if data[start + 3] not in (0xE0, 0xE1):
        return Scan(end=end(start))
    at, scan, seen, size = marks.walk(start + 2, limit)
    if not {0xDB, 0xC4} <= seen:
        return Scan(*size, end=end(start))
    if not scan or at >= limit:
        return Scan(*size, end=end(at))
    hit = marks.first(marks.broken, at, limit)
    restart = marks.first(marks.restarts, at, limit if hit is None else hit)
    if hit is not None and data[hit + 1] == 0xD9:
        return Scan(*size, end=hit - start, restarts=restart is not None)
    return Scan(*size, broken=None if hit is None else hit - start, restarts=restart is not None)


def jpeg_size(scan: Scan, data: bytes, max_len: int, start: int = 0, marks: JpegMarks | None = None) -> int:
    """To the end marker; else at most what the dimensions allow and up to the break, or to a stray end marker."""
    if scan.end is not None:
        return scan.end + 2
    limit = min(max_len, len(data) - start)
    if scan.width and scan.height:
        limit = min(limit, scan.width * scan.height * 9 // 10)
    if scan.broken is not None:
        return min(scan.broken, limit)
    marks = marks or JpegMarks(data)
    stray = marks.first(marks.ends, start, start + limit)
    return stray - start + 2 if stray is not None else limit


_ENTRY = re.compile(rb"PK\x03\x04")


def zip_ends(data: bytes) -> tuple[list[int], list[int]]:
    """Places of all local entries that have a whole header, and for each the end of the furthest one when jumping from one to the next."""
    places = [m.start() for m in _ENTRY.finditer(data) if m.start() + 30 <= len(data)]
    ends = [at + 30 + number(data, at + 26, 2) + number(data, at + 28, 2) + number(data, at + 18, 4) for at in places]
    for k in reversed(range(len(places))):
        after = bisect_left(places, ends[k])
        if after < len(places):
            ends[k] = max(ends[k], ends[after])
    return places, ends


def zip_by_headers(data: bytes, max_len: int, start: int = 0, entries: tuple[list[int], list[int]] | None = None) -> int:
    """The end of the furthest local entry from start on, jumping from one to the next; entries are those of all data, if known."""
    places, ends = entries or zip_ends(data)
    first = bisect_left(places, start)
    return min(ends[first] - start, max_len) if first < len(places) else min(FALLBACK, max_len, len(data) - start)


_NUMBER = re.compile(rb"[ \t\r\n]*0*(\d+)")
_XREF = re.compile(rb"[ \t\r\n]*xref|trailer")
_XREF_STREAM = re.compile(rb"/Type ?/XRef")
_NEAR = (0, -10, -20, -50, 10, 20, 50)


class PdfMarks:
    """The last places of a PDF's keywords before the last %%EOF of some data, found once for all headers in it."""

    def __init__(self, data: bytes, stop: int | None = None) -> None:
        self.data, self.eof = data, data.rfind(b"%%EOF") if stop is None else stop - 5
        self.stop = self.eof + 5
        self.last = {w: data.rfind(w, 0, self.stop) for w in (b"startxref", b"/Length", b"endobj", b"trailer")}

    @cached_property
    def streams(self) -> list[int]:
        return [m.start() for m in _XREF_STREAM.finditer(self.data, 0, self.stop)]

    @cached_property
    def eofs(self) -> list[int]:
        return [m.start() for m in re.finditer(b"%%EOF", self.data)]

    def valid(self, start: int) -> bool:
        """The last startxref leads near a cross-reference table, or the usual keywords are there."""
        data, at = self.data, self.last[b"startxref"]
        if at >= start and (m := _NUMBER.match(data, at + 9, self.stop)) and len(m[1]) <= 20 and (where := int(m[1])) < 1 << 64:
            near = [start + where + d for d in _NEAR if where + d >= 0 and start + where + d < self.stop]
            if any(_XREF.match(data, k, self.stop) for k in near) or (near and self.streams and self.streams[-1] >= min(near)):
                return True
        has = {w: place >= start for w, place in self.last.items()}
        return (has[b"/Length"] or has[b"endobj"]) and (has[b"startxref"] or has[b"trailer"])


def pdf_valid(data: bytes) -> bool:
    return PdfMarks(data, len(data)).valid(0)


def pdf_size(data: bytes, max_len: int, start: int = 0, marks: PdfMarks | None = None) -> int:
    """From start to the last %%EOF of data and the white space after it in a sound file, else to the first one."""
    marks = marks or PdfMarks(data)
    if marks.eof < start:
        return min(FALLBACK, max_len, len(data) - start)
    if marks.valid(start):
        end = _WHITE.match(data, marks.stop).end()
        return min(end - start, max_len)
    return min(marks.eofs[bisect_left(marks.eofs, start)] + 5 - start, max_len)


_WHITE = re.compile(rb"[\r\n \t]*")
_ATOM = re.compile(rb"(?:[A-Za-z0-9 .\-_()]|\xa9){4}")
_LETTERS = np.array([_ATOM.fullmatch(bytes([k]) * 4) is not None for k in range(256)])


def _atoms(data: bytes, start: int, stop: int):  # noqa: ANN202
    """(type, start, size) of successive atoms; ends with None at one whose size or type can't be."""
    while start + 8 <= stop:
        size, kind = number(data, start, 4, "big"), bytes(data[start + 4 : start + 8])
        if size < 8 or start + size > stop:
            yield None
            return
        yield kind, start, size
        start += size


def _mvhd(data: bytes, at: int, size: int) -> bool:
    return size >= 108 and data[at + 8] <= 1 and data[at + 12 : at + 20] != bytes(8) and 1 <= number(data, at + 20, 4, "big") <= 1_000_000


def _trak(data: bytes, at: int, size: int) -> bool:
    seen = set()
    for atom in _atoms(data, at + 8, at + size):
        if atom is None or (atom[0] == b"tkhd" and atom[2] < 32) or not _ATOM.fullmatch(atom[0]):
            return False
        seen.add(atom[0])
    return {b"tkhd", b"mdia"} <= seen


def _lettered(values: np.ndarray) -> np.ndarray:
    """The places of data at which an atom may start: its type is made of such letters, and it ends within the data."""
    n = len(values) - 7
    out = []
    for lo in range(0, max(n, 0), 1 << 20):
        v = values[lo : min(lo + (1 << 20), n) + 7]
        ok = _LETTERS[v]
        at = np.flatnonzero(ok[4:-3] & ok[5:-2] & ok[6:-1] & ok[7:])
        size = sum(v[at + k].astype(np.int64) << 8 * (3 - k) for k in range(4))
        at = at[(size >= 8) & (size <= len(values) - lo - at)]
        out.append(at + lo)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class MovMarks:
    """Where atoms may start in some data, and where moov stands, found once."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.moov = [m.start() for m in re.finditer(b"moov", data)]
        self.atoms = _lettered(np.frombuffer(data, np.uint8)).tolist()


def mov_valid(data: bytes, start: int = 0, stop: int | None = None, marks: MovMarks | None = None) -> bool:
    """A moov atom between start and stop whose children are sound, with a movie header and a track.

    Atoms are passed from one to the next, and where there is none byte by byte, up to the first moov: as the type of the
    atom at hand or, beyond the first four bytes, as what stands at hand.
    """
    marks, stop = marks or MovMarks(data), len(data) if stop is None else stop
    at = start
    while at + 8 <= stop:
        k = bisect_left(marks.moov, at)
        while k < len(marks.moov) and at <= marks.moov[k] < at + 4 and marks.moov[k] < start + 4:
            k += 1  # neither the type of an atom from here on nor met beyond the first four bytes
        if k == len(marks.moov):
            return False
        moov = marks.moov[k]
        met = moov - 4 if moov >= at + 4 else moov
        k = bisect_left(marks.atoms, at)
        jump = None
        while k < len(marks.atoms) and marks.atoms[k] < met:
            if marks.atoms[k] + (size := number(data, marks.atoms[k], 4, "big")) <= stop:
                jump = marks.atoms[k] + size
                break
            k += 1
        if jump is None:
            return met + 8 <= stop and _moov(data, moov - 4, stop)
        at = jump
    return False


def _moov(data: bytes, at: int, stop: int) -> bool:
    size = number(data, at, 4, "big")
    if size < 8 or at + size > stop:
        return False
    seen = set()
    for atom in _atoms(data, at + 8, at + size):
        if atom is None or not _ATOM.fullmatch(atom[0]):
            return False
        check = {b"mvhd": _mvhd, b"trak": _trak}.get(atom[0])
        if check and not check(data, *atom[1:]):
            return False
        seen.add(atom[0])
    return {b"mvhd", b"trak"} <= seen


def mov_size(data: bytes, max_len: int, start: int = 0) -> int:
    """The end of the atoms that follow each other from start on, or of data where one goes beyond it or there is none."""
    at = start
    while at + 8 <= len(data):
        size = number(data, at, 4, "big")
        if size < 8 or not _ATOM.fullmatch(data, at + 4, at + 8):
            break
        if at + size > len(data):
            at = len(data)
            break
        at += size
    return min((at if at > start else len(data)) - start, max_len)


#: No gzip header is longer: 10 bytes, extra field, name, comment, check sum; and 5 of what follows.
GZIP_HEAD = 10 + 2 + 65535 + 1025 + 2049 + 2 + 5


def gzip_header_end(data: bytes) -> int | None:
    """Where the compressed data starts, if the optional fields are sound; data may end after GZIP_HEAD bytes."""
    if len(data) < 10:
        return None
    flags, at = data[3], 10
    if flags & 4:
        if at + 2 > len(data):
            return None
        at += 2 + number(data, at, 2)
    for bit, most in ((8, 1024), (16, 2048)):
        if flags & bit:
            end = data.find(0, at, at + most + 1)
            if end < 0 or any(c < 32 and c not in (9, 10, 13) or c == 127 for c in data[at:end]):
                return None
            at = end + 1
    at += 2 if flags & 2 else 0
    return at if at <= len(data) else None


def gzip_payload_valid(data: bytes, at: int, size: int | None = None) -> bool:
    """Whether what starts at `at` may be compressed data; data may be only the start of a file of that size, up to 5 bytes after `at`."""
    size = len(data) if size is None else size
    if size <= at + 8:
        return False
    kind = data[at] >> 1 & 3
    if kind == 3:
        return False
    return kind != 0 or (size >= at + 5 and number(data, at + 1, 2) == 0xFFFF ^ number(data, at + 3, 2))


def ff_validity(data: bytes) -> float:
    """Of the pairs that start with FF, the share whose second byte may stand in JPEG scan data; 1 without such pairs."""
    seen = valid = 0
    at = data.find(b"\xff")
    while 0 <= at < len(data) - 1:
        seen += 1
        b = data[at + 1]
        valid += b in (0x00, 0xD9) or 0xD0 <= b <= 0xD7
        at = data.find(b"\xff", at + 2)
    return valid / seen if seen else 1.0
