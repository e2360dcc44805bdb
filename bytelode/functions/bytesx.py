"""Columns over binary values: integers, byte-exact text views, masks and file names. Offsets start at 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = 0x3F
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def piece(data: Column, at: int | Column, n: int | Column) -> Column:
    return F.substring(data, F.lit(at).cast("int") + 1 if isinstance(at, int) else at.cast("int") + 1, F.lit(n) if isinstance(n, int) else n.cast("int"))


def unsigned(data: Column, at: int | Column, n: int, little: bool = True) -> Column:
    """The unsigned integer of n bytes as a long; 0 where data is too short; null beyond 2**63 - 1."""
    here = piece(data, at, n)
    there = F.octet_length(here) == n if isinstance(at, int) else (at >= 0) & (F.octet_length(here) == n)
    turned = F.encode(F.reverse(latin1(here)), "ISO-8859-1") if little and n > 1 else here
    return F.when(there, F.conv(F.hex(turned), 16, 10).try_cast("long")).otherwise(F.lit(0).cast("long"))


def u8(data: Column, at: int | Column) -> Column:
    return unsigned(data, at, 1)


def u16(data: Column, at: int | Column, little: bool = True) -> Column:
    return unsigned(data, at, 2, little)


def u32(data: Column, at: int | Column, little: bool = True) -> Column:
    return unsigned(data, at, 4, little)


def u64(data: Column, at: int | Column, little: bool = True) -> Column:
    return unsigned(data, at, 8, little)


def latin1(data: Column) -> Column:
    """One character for each byte."""
    return F.decode(data, "ISO-8859-1")


def fold(text: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(text, UPPER, LOWER)


def find(data: Column, pattern: bytes, fold_case: bool = False, start: Column | int = 0) -> Column:
    """Place of the first literal occurrence at or after start, else null."""
    text, what = latin1(data), pattern.decode("latin-1")
    if fold_case:
        text, what = fold(text), what.translate(str.maketrans(UPPER, LOWER))
    got = F.locate(what, text) if isinstance(start, int) and start == 0 else F.expr("null")
    if not (isinstance(start, int) and start == 0):
        got = F.call_function("locate", F.lit(what), text, F.lit(start).cast("int") + 1)
    return F.when(got > 0, (got - 1).cast("long"))


def starts_with(data: Column, head: bytes, at: int | Column = 0) -> Column:
    return F.coalesce(piece(data, at, len(head)) == F.lit(head), F.lit(False))


def matches(data: Column, pattern: bytes, at: int | Column = 0, fold_case: bool = False) -> Column:
    """Whether pattern stands at a place; the byte ? fits any byte. False beyond the end."""
    here = latin1(piece(data, at, len(pattern)))
    out = F.octet_length(piece(data, at, len(pattern))) == len(pattern)
    for k, byte in enumerate(pattern):
        if byte != WILDCARD:
            char, want = F.substring(here, k + 1, 1), chr(byte)
            out = out & ((fold(char) == want.translate(str.maketrans(UPPER, LOWER))) if fold_case else (char == want))
    return F.coalesce(out, F.lit(False))


def matches_column(data: Column, pattern: Column, fold_case: Column | bool = False) -> Column:
    """As `matches`, of two equally long values that are both columns."""
    a, b = latin1(data), latin1(pattern)
    same = F.forall(F.sequence(F.lit(1), F.length(b)), lambda k: (F.substr(b, k, F.lit(1)) == "?") | (F.substr(a, k, F.lit(1)) == F.substr(b, k, F.lit(1))))
    folded = F.forall(F.sequence(F.lit(1), F.length(b)), lambda k: (F.substr(b, k, F.lit(1)) == "?") | (F.substr(fold(a), k, F.lit(1)) == F.substr(fold(b), k, F.lit(1))))
    fold_case = F.lit(fold_case) if isinstance(fold_case, bool) else fold_case
    return F.when(F.length(a) != F.length(b), False).when(F.length(b) == 0, True).otherwise(F.when(fold_case, folded).otherwise(same))


def contains_any(data: Column, markers: list[bytes]) -> Column:
    out = F.lit(not markers)
    for m in markers:
        out = out | F.contains(data, F.lit(m))
    return out


def align_down(x: Column, block: int) -> Column:
    return x - F.pmod(x, F.lit(block))


def align_up(x: Column, block: int) -> Column:
    return align_down(x + (block - 1), block)


def mebibytes(x: Column) -> Column:
    return F.floor(x / (1 << 20)).cast("long")


def clean_filename(name: Column, most: int) -> Column:
    """stem_ext of a path's last part: other than letters and digits become one _, A-Z lower case, none at the ends; cut to most characters."""
    last = F.regexp_extract(name, r"([^/]*)/*$", 1)
    stem = F.when(last.rlike(r"^.+\.[^.]*$"), F.regexp_extract(last, r"^(.+)\.[^.]*$", 1)).otherwise(last)
    extension = F.when(last.rlike(r"^.+\.[^.]+$"), F.regexp_extract(last, r"\.([^.]+)$", 1)).otherwise("")
    whole = F.when(extension == "", stem).otherwise(F.concat(stem, F.lit("_"), extension))
    parts = F.regexp_replace(fold(whole), r"[^\p{L}\p{N}]+", "_")
    return F.left(F.regexp_replace(parts, r"^_+|_+$", ""), F.lit(most))


def output_filename(seq: Column, offset: Column, suffix: Column, source: Column | None = None) -> Column:
    """{seq}-{offset}.{suffix}, after the first 30 characters of the cleaned source name if one is given."""
    name = F.concat(seq.cast("string"), F.lit("-"), offset.cast("string"), F.lit("."), suffix)
    return name if source is None else F.concat(clean_filename(source, 30), F.lit("-"), name)


def recovered_filename(name: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", ""), F.lit("_recovered.jpg"))


def timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxx")


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 if they are all 0."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.coalesce(F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda a, x: a - (x / total) * F.log2(x / total)), F.lit(0.0))
