"""Sizes and structural checks of carved files as columns over one hit's facts (see operators.scan)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytesx import piece, starts_with, u8, u16, u32, unsigned
from .walkers import FALLBACK


def _capped(rem: Column, max_len: Column) -> Column:
    return F.least(rem, max_len)


def footer_size(rem: Column, max_len: Column, footer_at: Column, footer_len: Column) -> Column:
    """To the footer's end, however far; without one as much as is there, up to the longest."""
    return F.coalesce(footer_at + footer_len, _capped(rem, max_len))


def bmp_size(head: Column, rem: Column, max_len: Column) -> Column:
    return F.when(rem < 6, F.lit(0).cast("long")).otherwise(F.least(u32(head, 2), max_len))


def exe_size(probe: Column, rem: Column, max_len: Column) -> Column:
    """probe: what stands at the place of the PE header. Its image size, if sound, is the size."""
    image = u32(probe, 80)
    plain = _capped(rem, max_len)
    return F.when((rem >= 64) & starts_with(probe, b"PE\0\0") & (F.octet_length(probe) >= 84) & image.between(1, max_len), F.least(image, rem)).otherwise(plain)


def zip_size(eocd_at: Column, probe: Column, rem: Column, max_len: Column, walked: Column) -> Column:
    """probe: the end-of-directory record, if there is room for one; else the walk over the entries decides."""
    return F.when(eocd_at <= rem - 22, F.least(eocd_at + 22 + u16(probe, 20), max_len)).otherwise(walked)


def gzip_fallback(rem: Column, max_len: Column) -> Column:
    return F.least(F.lit(FALLBACK).cast("long"), rem, max_len)


def jpeg_cap(width: Column, height: Column) -> Column:
    """A plausible most for pixels of these dimensions; null if either is 0."""
    return F.when((width > 0) & (height > 0), F.floor(width.cast("long") * height.cast("long") * 9 / 10).cast("long"))


def png_valid(head: Column, size: Column) -> Column:
    sides = u32(head, 16, False).between(1, 99_999) & u32(head, 20, False).between(1, 99_999)
    return (size >= 29) & starts_with(head, bytes.fromhex("89504E470D0A1A0A")) & (u32(head, 8, False) == 13) & starts_with(head, b"IHDR", 12) & sides


def gif_valid(head: Column, size: Column) -> Column:
    return (size >= 10) & (starts_with(head, b"GIF87a") | starts_with(head, b"GIF89a")) & (u16(head, 6) > 0) & (u16(head, 8) > 0)


#: Place and bytes of each number in the headers of a bitmap that `bmp_valid` needs.
_BMP = {"named": (2, 4), "reserved": (6, 4), "pixels": (10, 4), "header": (14, 4), "width": (18, 4), "tall": (22, 4), "planes": (26, 2), "depth": (28, 2), "packing": (30, 4), "image": (34, 4), "across": (38, 4), "down": (42, 4), "colours": (46, 4), "important": (50, 4)}


def bmp_numbers(head: Column) -> Column:
    """The numbers of a bitmap's headers as one array: as a column of its own it keeps the code of the check short."""
    return F.array(*(unsigned(head, at, n) for at, n in _BMP.values()))


def bmp_valid(head: Column, size: Column, numbers: Column | None = None) -> Column:
    """File header, bitmap header and the agreement of image size, resolution and colours; numbers: `bmp_numbers`, if at hand."""
    has = {name: unsigned(head, *_BMP[name]) if numbers is None else F.get(numbers, F.lit(k)) for k, name in enumerate(_BMP)}
    named, pixels = has["named"], has["pixels"]
    file = (size >= 54) & starts_with(head, b"BM") & named.between(54, size) & (has["reserved"] == 0) & pixels.between(54, named)
    width, tall, depth, packing = (has[k] for k in ("width", "tall", "depth", "packing"))
    height = F.when(tall > 0x80000000, F.lit(1 << 32) - tall).otherwise(tall)
    bitmap = has["header"].isin(40, 52, 56, 108, 124) & width.between(1, 65_536) & height.between(1, 65_536) & (has["planes"] == 1) & depth.isin(1, 4, 8, 16, 24, 32)
    bitmap = bitmap & (packing <= 5) & ((packing != 1) | (depth == 8)) & ((packing != 2) | (depth == 4))
    image, colours, important = (has[k] for k in ("image", "colours", "important"))
    row = F.floor((width * depth + 31) / 32).cast("long") * 4
    data = (image == 0) | (((packing != 0) | (image == F.pmod(row * height, F.lit(1 << 32)))) & (pixels + image <= named))
    palette = F.when(depth == 1, colours <= 2).when(depth == 4, colours <= 16).when(depth == 8, colours <= 256).otherwise(True)
    return file & bitmap & data & (has["across"] <= 1_000_000) & (has["down"] <= 1_000_000) & palette & ((colours == 0) | (important <= colours))


def exe_valid(head: Column, probe: Column, size: Column) -> Column:
    return (size >= 64) & (u32(head, 0x3C) + 4 <= size) & starts_with(probe, b"PE\0\0")


def mpg_valid(head: Column, size: Column) -> Column:
    """An MPEG pack header, of version 2 by its two top bits or else of version 1; stuffing is all ones."""
    odd = lambda k: u8(head, k).bitwiseAND(F.lit(1)) == 1
    stuffing = u8(head, 13).bitwiseAND(F.lit(7))
    ones = F.hex(piece(head, 14, stuffing)) == F.expr("repeat('FF', 7)").substr(F.lit(1), (stuffing * 2).cast("int"))
    second = (stuffing == 0) | (size < 14 + stuffing) | ones
    first = (u8(head, 4).bitwiseAND(F.lit(0xF0)) == 0x20) & odd(4) & odd(6) & odd(8)
    return (size >= 14) & (u32(head, 0, False) == 0x1BA) & F.when(u8(head, 4).bitwiseAND(F.lit(0xC0)) == 0x40, second).otherwise(first)


def gzip_head_valid(head: Column, size: Column) -> Column:
    time, system = u32(head, 4), u8(head, 9)
    fixed = (size >= 10) & starts_with(head, b"\x1f\x8b\x08") & (u8(head, 3).bitwiseAND(F.lit(0xE0)) == 0)
    return fixed & ((time == 0) | time.between(86_400, 3_153_600_000)) & u8(head, 8).isin(0, 2, 4) & ((system <= 13) | (system == 255))


def _by_kind(kind: Column, rules: dict[str, Callable[[], Column]], kinds: set[str], otherwise: Column) -> Column:
    """The rule of a hit's type; rules of types that the catalog lacks are not even built."""
    out = None
    for name, rule in rules.items():
        if name in kinds:
            out = (F if out is None else out).when(kind == name, rule())
    return otherwise if out is None else out.otherwise(otherwise)


def size(h: dict[str, Column], kinds: set[str]) -> Column:
    """The size of a hit by the rule of its type. 0 and sizes beyond what is there make no file."""
    kind, rem, most = h["file_type"], h["rem"], h["max_len"]
    plain = _capped(rem, most)
    walked = lambda: F.coalesce(h["walked"], plain)
    no_footer = _by_kind(kind, {"bmp": lambda: bmp_size(h["head"], rem, most), "exe": lambda: exe_size(h["probe"], rem, most), "mov": walked, "mpg": walked, "gzip": walked}, kinds, plain)
    by_footer = F.when(h["footer_len"] > 0, footer_size(rem, most, h["footer_at"], h["footer_len"])).otherwise(no_footer)
    return _by_kind(kind, {"zip": lambda: zip_size(h["probe_at"], h["probe"], rem, most, h["walked"]), "pdf": lambda: h["walked"], "jpeg": lambda: h["walked"]}, kinds, by_footer)


def valid(h: dict[str, Column], size: Column, kinds: set[str]) -> Column:
    """The structural check of a hit's type, and at least one marker inside if its spec has any."""
    kind, head, sound = h["file_type"], h["head"], F.coalesce(h["sound"], F.lit(False))
    rules = {
        "png": lambda: png_valid(head, size), "gif": lambda: gif_valid(head, size), "bmp": lambda: bmp_valid(head, size, h.get("numbers")), "exe": lambda: exe_valid(head, h["probe"], size),
        "mpg": lambda: mpg_valid(head, size), "gzip": lambda: gzip_head_valid(head, size) & sound, "mov": lambda: sound,
    }
    return _by_kind(kind, rules, kinds, F.lit(True)) & ((h["n_markers"] == 0) | F.coalesce(h["marker_end"] <= size, F.lit(False)))
