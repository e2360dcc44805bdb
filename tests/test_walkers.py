"""Walkers that share what they find, and the decoder, against slow and plain code."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from bytelode.functions import huffman as H
from bytelode.functions import walkers as W
from bytelode.operators import scan
from bytelode.operators.signatures import Signatures
from bytelode.operators.specs import Spec, builtin_specs, select_types
from tests.test_formats import SOF, SOS, START, TABLES


# --- JPEG structure ---


def jpeg_by_hand(buf: bytes, max_len: int) -> W.Scan:
    """Byte after byte, as the rules read."""
    limit = min(max_len, len(buf))

    def end(lo: int) -> int | None:
        return next((k for k in range(lo, limit - 1) if buf[k : k + 2] == b"\xff\xd9"), None)

    if len(buf) < 10:
        return W.Scan(end=end(0))
    if buf[:3] != b"\xff\xd8\xff":
        return W.Scan()
    if buf[3] not in (0xE0, 0xE1):
        return W.Scan(end=end(0))
    at, seen, scanning, size = 2, set(), False, (None, None)
    while at + 2 <= limit and buf[at] == 0xFF:
        kind = buf[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        at += 2
        length = int.from_bytes(buf[at : at + 2], "big") if at + 2 <= len(buf) else 0
        if kind == 0xD8:
            continue
        if kind == 0xD9:
            break
        if kind == 0xDA:
            scanning = True
            at += length if length >= 2 else 0
            break
        if length < 2 or at + length > len(buf):
            break
        seen.add(kind)
        if kind in (0xC0, 0xC1, 0xC2) and at + 7 <= len(buf):
            h, w = int.from_bytes(buf[at + 3 : at + 5], "big"), int.from_bytes(buf[at + 5 : at + 7], "big")
            size = (w, h) if w and h else size
        at += length
    if not {0xDB, 0xC4} <= seen:
        return W.Scan(*size, end=end(0))
    if not scanning or at >= limit:
        return W.Scan(*size, end=end(at))
    restarts = False
    while at < limit:
        if buf[at] != 0xFF or at + 1 >= limit:
            at += 1
        elif buf[at + 1] == 0xD9:
            return W.Scan(*size, end=at, restarts=restarts)
        elif buf[at + 1] == 0 or 0xD0 <= buf[at + 1] <= 0xD7:
            restarts |= buf[at + 1] != 0
            at += 2
        else:
            return W.Scan(*size, broken=at, restarts=restarts)
    return W.Scan(*size, restarts=restarts)


PARTS = [START, b"\xff\xd8\xff\xe1\0\4ab", TABLES, SOF, SOS, b"\xff\xdb\0\3x", b"\xff\xc4\0\2", b"\xff\xc0\0\2\1\0\5\0\6", b"\xff\xff", b"\xff\xd8", b"\xff\xd9", b"\xff\xd3", b"\xff\0", b"\xff", b"\xff\x11", b"abc", b"\xff\xda\0\1", b"\xff\xda\0\6abcd", b"\xff\xe0\xff\xff", b"\xff\xd8\xff\xee"]


def test_jpeg_structure_of_many() -> None:
    draw = random.Random(3)
    for _ in range(400):
        data = b"".join(draw.choice(PARTS) for _ in range(draw.randrange(1, 30)))
        marks = W.JpegMarks(data)
        for start in range(len(data)):
            if data[start : start + 2] == b"\xff\xd8":
                for most in (7, 40, 1 << 20):
                    found = W.jpeg(data, most, start, marks)
                    assert found == jpeg_by_hand(data[start:], most), (data, start, most)
                    assert W.jpeg_size(found, data, most, start, marks) == W.jpeg_size(found, data[start:], most)


def test_jpeg_chains_are_remembered() -> None:
    """Long chains of short segments, met by many headers."""
    draw = random.Random(4)
    data = b"".join(draw.choice([b"\xff\xd8\xff\xe0\0\4ab", b"\xff\xe2\0\2", TABLES, SOF]) for _ in range(700)) + SOS + b"123\xff\xd9"
    marks = W.JpegMarks(data)
    for start in range(0, len(data), 97):
        start = data.find(b"\xff\xd8\xff", start)
        for most in (1 << 20, 5000) if start >= 0 else ():
            assert W.jpeg(data, most, start, marks) == jpeg_by_hand(data[start:], most)


def test_dense_chunks_take_linear_time() -> None:
    """Headers every 256 bytes: four times the bytes may take eight times the time, not sixteen."""
    draw = random.Random(5)
    specs = select_types(builtin_specs(), ["jpg", "pdf", "mov", "gif", "zip", "htm"])
    unit = b"".join(h + draw.randbytes(40) for h in (b"\xff\xd8\xff\xe0\0\x10", b"%PDF-1.4", b"moov", b"GIF89a", b"PK\3\4", b"<html"))[:256]
    took = []
    for n in (2_000, 8_000):
        data = unit * n + b"%%EOF"
        before = time.process_time()
        assert sum(1 for _ in scan.chunk_hits(data, specs)) >= 5 * n
        took.append(time.process_time() - before)
    assert took[1] < 8 * took[0] + 1


# --- other formats ---


def mov_by_hand(data: bytes) -> bool:
    at = 0
    letters = {*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 .-_()", 0xA9}
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        moov = at - 4 if data[at : at + 4] == b"moov" and at >= 4 else at if kind == b"moov" else None
        if moov is not None:
            return W._moov(data, moov, len(data))
        at += size if {*kind} <= letters and 8 <= size <= len(data) - at else 1
    return False


def test_mov_from_any_start() -> None:
    atom = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    head = atom(b"mvhd", bytes(7) + b"\1" + bytes(4) + b"\0\0\1\0" + bytes(84))
    track = atom(b"trak", atom(b"tkhd", bytes(84)) + atom(b"mdia", b""))
    parts = [atom(b"moov", head + track), atom(b"moov", head), b"moov", atom(b"free", b"abc"), atom(b"a b(", b""), b"\0\0\0\x14ftyp", b"x", bytes(3), b"\0\0\0\x0cmo", track]
    draw, seen = random.Random(6), set()
    for _ in range(1500):
        data = b"".join(draw.choice(parts) for _ in range(draw.randrange(1, 7)))
        marks = W.MovMarks(data)
        for start in (0, draw.randrange(len(data))):
            stop = draw.choice([len(data), draw.randrange(start, len(data) + 1)])
            seen.add(found := W.mov_valid(data, start, stop, marks))
            assert found == mov_by_hand(data[start:stop]), (data, start, stop)
    assert seen == {True, False}


@pytest.mark.parametrize(("white", "ok"), [(b" ", True), (b"\t\r\n", True), (b"\0", False), (b"\x0b", False), (b"\x0c", False)])
def test_pdf_white_space(white: bytes, ok: bool) -> None:
    data = b"%PDF-1.4\nxref\n" + b"startxref" + white + b"0009\n%%EOF"
    assert W.pdf_valid(data) is ok
    assert W.pdf_valid(b"%PDF-1.4\n" + white + b"xref\nstartxref 9\n%%EOF") is ok
    assert not W.pdf_valid(b"%PDF-1.4\nxref\nstartxref" + b"9" * 5000 + b"%%EOF")


# --- the decoder ---


class Bits:
    """One bit after the other, taking up bytes as late as may be."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.over = data, 0, [], False

    def fill(self) -> None:
        while len(self.held) <= 24 and not self.over:
            b = self.data[self.at : self.at + 1]
            stuffed = self.data[self.at : self.at + 2] == b"\xff\0"
            if not b or (b == b"\xff" and not stuffed):
                self.over = True
            else:
                self.at += 1 + stuffed
                self.held += [b[0] >> k & 1 for k in range(7, -1, -1)]

    def take(self, n: int) -> int | None:
        if len(self.held) < n:
            self.fill()
        if len(self.held) < n:
            return None
        out = int("".join(map(str, self.held[:n])), 2)
        del self.held[:n]
        return out


def units_by_hand(blocks: list[tuple[dict, dict]], data: bytes) -> int:
    bits, n = Bits(data), 0

    def symbol(codes: dict) -> int | None:
        code = 0
        for length in range(1, 17):
            bit = bits.take(1)
            if bit is None:
                return None
            code = code << 1 | bit
            if (length, code) in codes:
                return codes[length, code]
        return None

    def block(dc: dict, ac: dict) -> bool:
        s = symbol(dc)
        if s is None or s > 11 or (s and bits.take(s) is None):
            return False
        k = 0
        while k < 63:
            s = symbol(ac)
            if s is None:
                return False
            if s == 0:
                break
            if s == 0xF0:
                k += 16
                continue
            if not 1 <= s & 15 <= 10 or bits.take(s & 15) is None:
                return False
            k += (s >> 4) + 1
        return True

    while not (bits.over and not bits.held):
        if not bits.held:
            pair = bits.data[bits.at : bits.at + 2]
            if len(pair) == 2 and pair[0] == 0xFF and pair[1]:
                if not 0xD0 <= pair[1] <= 0xD7:
                    return n
                bits.at, bits.over = bits.at + 2, False
                continue
        if not all(block(*b) for b in blocks):
            return n
        n += 1
    return n


def codes_of(counts: bytes, symbols: bytes) -> dict:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[length, code] = s
            code += 1
        at += n
        code <<= 1
    return out


def test_decoder_bit_by_bit() -> None:
    draw = random.Random(9)
    for _ in range(60):
        tables = []
        for symbols in ([0, 1, 2, 3, 12, 11], [0, 1, 0x11, 0xF0, 2, 0x10, 0x2A, 0x0B]):
            counts = bytearray(16)
            counts[draw.randrange(1, 3)] = 2
            counts[draw.randrange(3, 9)] += len(symbols) - 2
            draw.shuffle(symbols)
            tables.append((bytes(counts), bytes(symbols)))
        made = [H.table(c + s) for c, s in tables]
        ctx = H.Context({(0, 0): made[0], (1, 0): made[1]}, [(draw.choice([1, 2]), 0, 0), (1, 0, 0)])
        slow = [(codes_of(*tables[0]), codes_of(*tables[1]))] * len(ctx.blocks())
        data = [b"".join(draw.choice([bytes([draw.randrange(255)]), b"\0", b"\0\0\0\0", b"\xff\0", draw.choice([b"\xff\xd0", b"\xff\xd9", b"\xff", b"\xff\x11"])]) for _ in range(draw.randrange(40))) for _ in range(50)]
        wanted = [units_by_hand(slow, d) for d in data]
        assert H.count_all([(ctx, d) for d in data]) == wanted
        assert [H.count_units(ctx, d) for d in data] == wanted
    assert max(wanted) > 0


def header(sampling: int = 0x11, within: bytes = b"", parts: int = 1, frame: bytes = b"\xff\xc0") -> bytes:
    dht = b"".join(b"\xff\xc4\0\x14" + bytes([k]) + b"\1" + bytes(15) + b"\0" for k in (0, 16))
    return START + within + dht + frame + b"\0\x0b\x08\0\x08\0\x08\1\1" + bytes([sampling]) + b"\0" + b"\xff\xda\0\x08" + bytes([parts]) + b"\1\0\0\x3f\0"


def test_broken_headers_end() -> None:
    """Two bits a block of the one code; nothing that a header can hold makes the count go on for ever."""
    scan_data = bytes(6)
    assert H.unit_count(header(), scan_data) == 24 and H.unit_count(header(0x21), scan_data) == 12
    for sampling in (0, 1, 0x10):
        assert H.unit_count(header(sampling), scan_data) == 24
    assert H.unit_count(header(within=b"\xff\xd8"), scan_data) == 24 and H.unit_count(header(within=b"\xff\xff\xff"), scan_data) == 24
    assert H.unit_count(header(within=b"\xff\xd9"), scan_data) is None
    assert H.unit_count(header(parts=3), scan_data) is None and H.unit_count(header(parts=0), scan_data) is None
    assert H.unit_count(header()[:-1], scan_data) is None and H.unit_count(header(frame=b"\xff\xc2"), scan_data) is None


# --- signatures ---


def test_signatures_against_plain_search() -> None:
    draw = random.Random(11)
    for _ in range(60):
        specs = [Spec("Config", "x", bytes(draw.choice(b"abA\0?") for _ in range(draw.randrange(1, 5))), None, 9, draw.random() < 0.6, draw.choice(["Forward", "Ascii", "Reverse"])) for _ in range(draw.randrange(1, 12))]
        data = bytes(draw.choice(b"abABc\0") for _ in range(draw.randrange(200)))
        for block in (0, 3):
            found = Signatures(specs).places(data, block)
            for k, s in enumerate(specs):
                n = len(s.header)
                fold = (lambda b: b) if s.case_sensitive else bytes.lower
                fits = [at for at in range(len(data) - n + 1) if all(h == 0x3F or fold(bytes([h])) == fold(data[at + i : at + i + 1]) for i, h in enumerate(s.header))]
                fits = [at for at in fits if (at % block == 0 if block else s.search_type != "Ascii" or all(map(scan.printable, data[at : at + n])))]
                assert found.get(k, np.zeros(0)).tolist() == fits
                assert scan.positions(data, s, block) == (fits[::-1] if s.search_type == "Reverse" and not block else fits)


def test_signatures_across_steps(monkeypatch) -> None:
    monkeypatch.setattr("bytelode.operators.signatures.STEP", 16)
    data = b"abcab" * 40
    assert Signatures([Spec("Config", "x", b"cab", None, 9)]).find(data)[0].tolist() == list(range(2, 200, 5))


def test_time_does_not_grow_with_the_catalog() -> None:
    draw = random.Random(12)
    data = draw.randbytes(4 << 20)
    took = []
    for n in (20, 4000):
        signatures = Signatures([Spec("Config", "x", draw.randbytes(6), None, 9) for _ in range(n)])
        before = time.process_time()
        signatures.find(data)
        took.append(time.process_time() - before)
    assert took[1] < 12 * took[0] + 2
