"""Byte vectors for the format rules, each built from its layout."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from bytelode.functions import bytesx as B
from bytelode.functions import extents as X
from bytelode.functions import huffman as H
from bytelode.functions import walkers as W
from bytelode.operators import scan, select
from bytelode.operators.specs import Spec, builtin_specs, combined_specs, filter_types, load_specs, parse_types, save_specs, select_types, specs_frame, union_specs

LIMIT = 50 << 20
TABLES = b"\xff\xdb\0\x43\0" + b"\x10" * 64 + b"\xff\xc4\0\x14\0\1" + bytes(15) + b"\0"
SOF = b"\xff\xc0\0\x0b\x08\0\x64\0\x64\1\1\x11\0"
SOS = b"\xff\xda\0\x08\1\1\0\0\x3f\0"
START = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0"


def bmp(**changed: int) -> bytes:
    f = {"size": 54, "reserved": 0, "pixels": 54, "dib": 40, "w": 100, "h": 100, "planes": 1, "bpp": 24, "comp": 0, "image": 0, "x": 2835, "y": 2835, "colours": 0, "important": 0} | changed
    return b"BM" + struct.pack("<IIIIIIHHIIIIII", *(v & 0xFFFFFFFF if k not in ("planes", "bpp") else v for k, v in f.items()))


def check(spark, rule, data: bytes):
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    return df.select(rule(F.col("b"), F.octet_length("b").cast("long"))).first()[0]


@pytest.mark.parametrize(("changed", "ok"), [({}, True), ({"size": 50}, False), ({"reserved": 1}, False), ({"pixels": 60}, False), ({"dib": 41}, False), ({"w": 0}, False), ({"w": 65537}, False), ({"h": -100}, True), ({"h": 0}, False), ({"planes": 2}, False), ({"bpp": 5}, False), ({"comp": 6}, False), ({"comp": 1}, False), ({"comp": 1, "bpp": 8}, True), ({"image": 1}, False), ({"x": 2_000_000}, False), ({"bpp": 1, "colours": 3}, False), ({"colours": 1, "important": 2}, False)])
def test_bmp(spark, changed: dict, ok: bool) -> None:
    assert check(spark, X.bmp_valid, bmp(**changed)) is ok


def test_png_gif_exe_mpg_gz(spark) -> None:
    png = lambda w, h: bytes.fromhex("89504E470D0A1A0A") + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\2\0\0\0"
    assert check(spark, X.png_valid, png(1, 99_999)) and not check(spark, X.png_valid, png(0, 5)) and not check(spark, X.png_valid, png(100_000, 5)) and not check(spark, X.png_valid, png(1, 1)[:28])
    assert check(spark, X.gif_valid, b"GIF89a\1\0\1\0") and not check(spark, X.gif_valid, b"GIF88a\1\0\1\0") and not check(spark, X.gif_valid, b"GIF87a\0\0\1\0")
    exe = bytearray(1500)
    exe[0x3C], exe[64:68], exe[144:148] = 64, b"PE\0\0", struct.pack("<I", 1000)
    probe = lambda b: B.piece(b, B.u32(b, 0x3C), 84)
    assert check(spark, lambda b, n: X.exe_size(probe(b), n, F.lit(LIMIT)), bytes(exe)) == 1000
    assert check(spark, lambda b, n: X.exe_valid(b, probe(b), n), bytes(exe)) and not check(spark, lambda b, n: X.exe_valid(b, probe(b), n), bytes(1500))
    assert check(spark, X.mpg_valid, bytes.fromhex("000001BA21000180010001000000")) and check(spark, X.mpg_valid, bytes.fromhex("000001BA4400000000000000000000"))
    assert not check(spark, X.mpg_valid, bytes.fromhex("000001BA4400000000000000000200FF"))
    gz = bytes.fromhex("1F8B080000000000") + b"\0\xff"
    assert check(spark, X.gzip_head_valid, gz) and not check(spark, X.gzip_head_valid, gz[:4] + b"\1\0\0\0" + gz[8:]) and not check(spark, X.gzip_head_valid, gz[:3] + b"\xe0" + gz[4:])


def test_jpeg_structure() -> None:
    whole = START + TABLES + SOF + SOS + b"\x12\xff\0\x34\xff\xd0\x56\xff\xd9tail"
    s = W.jpeg(whole, LIMIT)
    assert (s.width, s.height, s.restarts, s.status) == (100, 100, True, "complete")
    assert W.jpeg_size(s, whole, LIMIT) == len(whole) - 4
    cut = START + TABLES + SOF + SOS + b"\x12\x34" * 20
    assert W.jpeg(cut, LIMIT).status == "truncated" and W.jpeg_size(W.jpeg(cut, LIMIT), cut, LIMIT) == len(cut)
    broken = START + TABLES + SOF + SOS + b"\x12\x34\xff\x11" + bytes(50)
    s = W.jpeg(broken, LIMIT)
    assert s.status == "fragmented" and broken[s.broken : s.broken + 2] == b"\xff\x11" and W.jpeg_size(s, broken, LIMIT) == s.broken
    assert W.jpeg(b"\xff\xd8\xff\xe0" + bytes(96) + b"\xff\xd9", LIMIT).end == 100  # no tables: the first end marker
    assert W.jpeg(b"\xff\xd8\xff\x11" + bytes(30), LIMIT).status == "truncated"


def test_other_walkers() -> None:
    local = b"PK\3\4" + bytes(14) + struct.pack("<II", 5, 5) + struct.pack("<HH", 8, 0) + b"test.txthello"
    assert W.zip_by_headers(local + local + b"rest", LIMIT) == 2 * len(local)
    assert W.zip_by_headers(b"nothing", LIMIT) == 7
    pdf = b"%PDF-1.4\nxref\n0 1\n0000000000 65535 f \nstartxref\n9\n%%EOF\n"
    assert W.pdf_size(pdf, LIMIT) == len(pdf) and W.pdf_valid(pdf)
    assert W.pdf_size(b"%PDF-1 text %%EOFmore", LIMIT) == 17 and W.pdf_size(b"%PDF-1", LIMIT) == 6
    atom = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    head = atom(b"mvhd", bytes(4) + struct.pack(">IIII", 123_456, 123_457, 1000, 30_000) + bytes(80))
    track = atom(b"trak", atom(b"tkhd", bytes(84)) + atom(b"mdia", bytes(8)))
    assert W.mov_valid(atom(b"moov", head + track)) and not W.mov_valid(atom(b"moov", head)) and not W.mov_valid(b"moov" + head)
    assert W.mov_size(atom(b"ftyp", b"abcd") + atom(b"moov", head + track), LIMIT) == 12 + 8 + len(head + track)
    gz = bytes.fromhex("1F8B0800000000000 0FF".replace(" ", "")) + b"\1\5\0\xfa\xffhello" + bytes(8)
    assert W.gzip_header_end(gz) == 10 and W.gzip_payload_valid(gz, 10)
    assert W.gzip_header_end(gz[:3] + b"\x08" + gz[4:10] + b"name\0" + gz[10:]) == 15
    assert W.gzip_header_end(gz[:3] + b"\x08" + gz[4:10] + b"na\1me\0") is None
    assert not W.gzip_payload_valid(gz[:10] + b"\6" + gz[11:], 10) and not W.gzip_payload_valid(gz[:10] + b"\1\5\0\xfa\xfe" + gz[15:], 10)


def test_pair_validity_and_huffman() -> None:
    assert W.ff_validity(b"") == W.ff_validity(b"\xff") == W.ff_validity(b"abc") == 1.0
    assert W.ff_validity(b"\xff\0\xff\xd3\xff\xd9\xff\x11") == 0.75
    t = H.table(bytes([0, 1, 2] + [0] * 13) + bytes([0, 1, 2]))
    assert {(int(t[k << 13]) >> 8, int(t[k << 13]) & 255) for k in range(4)} == {(2, 0), (3, 1), (3, 2)} and not t[4 << 13 :].any()
    dht = b"\xff\xc4\0\x14\0\1" + bytes(15) + b"\0" + b"\xff\xc4\0\x14\x10\1" + bytes(15) + b"\0"
    sof = b"\xff\xc0\0\x0b\x08\0\x08\0\x08\1\1\x11\0"
    header = START + dht + sof + SOS
    assert H.unit_count(header, b"\0\0") == 8  # two bits each: DC of 0, then end of block
    assert H.unit_count(header, b"\0\xff\xd0\0") == 4 and H.unit_count(header, bytes(4) + b"\xff\xd0\0\xff\xd9\0") == 20
    assert H.unit_count(START + sof + SOS, b"\0") is None and H.unit_count(header.replace(b"\xff\xc0", b"\xff\xc2"), b"\0") is None


def test_search() -> None:
    data = b"xx<HTML>aBa<html>"
    assert scan.find(data, b"<html", 0, False) == 2 and scan.find(data, b"<html") == 11 and scan.find(data, b"<h?ml") == 11 and scan.find(data, b"zz") is None
    assert scan.find_last(data, b"<h?ml", False) == 11 and scan.find_last(b"aaaa", b"aa") == 2
    spec = lambda kind="Forward", h=b"ab": Spec("Config", "x", h, None, 10, True, kind)
    assert list(scan.positions(b"ab\0abab", spec())) == [0, 3, 5] and list(scan.positions(b"ab\0abab", spec("Reverse"))) == [5, 3, 0]
    assert list(scan.positions(b"\xff\xd8\xff\xd8\xff", Spec("Jpeg", "jpg", b"\xff\xd8\xff", None, 9))) == [0, 2]
    assert list(scan.positions(b"ab\0aab.ab", spec(), 4)) == [0, 4]
    with pytest.raises(ValueError):
        spec(h=b"")


def test_specs(spark, tmp_path) -> None:
    b = builtin_specs()
    assert len(b) == 18 and [s.suffix for s in select_types(b, ["jpeg", "png"])] == ["jpg", "png"] and select_types(b, ["nope"]) == [] and select_types(b, ["x", "all"]) == b
    assert parse_types(" all ") == ["all"] and parse_types(" ") == [] and parse_types("a, b,,") == ["a", "b"]
    save_specs(b, str(tmp_path / "s.toml"))
    assert load_specs(str(tmp_path / "s.toml")) == b
    odd = [Spec("Config", 'a"b', b"\0?", b"", 5, False, "Reverse", (b"x", b""), 'said "so"\n\\ü')]
    save_specs(odd, str(tmp_path / "odd.toml"))
    assert [(s.suffix, s.markers, s.comment, s.search_type) for s in load_specs(str(tmp_path / "odd.toml"))] == [('a"b', (b"x", b""), 'said "so"\n\\ü', "Reverse")]
    assert len(combined_specs(["gif"], config_file=str(tmp_path / "s.toml"))) == 2 and len(combined_specs(["gif"], True)) == 0
    (tmp_path / "odd.toml").write_text('[[specs]]\nfile_type = "Nope"\nsuffix = "o"\nheader = [1]\nmax_len = 5\nsearch_type = "Sideways"\n')
    assert (load_specs(str(tmp_path / "odd.toml"))[0].file_type, load_specs(str(tmp_path / "odd.toml"))[0].search_type) == ("Config", "Forward")
    f = specs_frame(spark, b)
    assert [r.suffix for r in filter_types(f, ["jpeg"]).collect()] == ["jpg"]
    assert [r.spec_idx for r in union_specs(f, f).orderBy("spec_idx").collect()] == list(range(36))


def test_columns(spark) -> None:
    df = spark.createDataFrame([(bytearray(b"\1\2\3\4\xff\xff\xff\xff\xff\xff\xff\xff"), "a?c", "aXc")], "b binary, p string, t string")
    b = F.col("b")
    assert tuple(df.select(B.u16(b, 0), B.u32(b, 0, False), B.u64(b, 4), B.u32(b, 10)).first()) == (0x201, 0x1020304, None, 0)
    assert df.select(B.matches_column(F.encode("t", "UTF-8"), F.encode("p", "UTF-8"))).first()[0] is True
    names = spark.createDataFrame([("/d/My File!!.TXT",), ("__a__b.c.d",), ("été.Ö",), (None,), ("x" * 40,)], "n string")
    assert [r[0] for r in names.select(B.clean_filename(F.col("n"), 20)).collect()] == ["my_file_txt", "a_b_c_d", "été_Ö", None, "x" * 20]
    assert [r[0] for r in spark.range(0, 3).select(B.align_up(F.col("id") * 300, 512)).collect()] == [0, 512, 1024]
    assert names.limit(1).select(B.recovered_filename(F.col("n"))).first()[0] == "My File!!_recovered.jpg"


def test_greedy_and_numbers(spark) -> None:
    df = spark.createDataFrame([("a", 1, 0, 5), ("a", 1, 3, 9), ("a", 1, 5, 0), ("a", 2, 1, 1), ("b", 1, 0, 1)], "image string, part int, pos long, adv long")
    kept = select.greedy(df, ["image", "part"], "pos", "adv")
    out = select.number(kept, "image", "part", [F.col("pos")]).orderBy("image", "seq").collect()
    assert [(r.image, r.part, r.pos, r.seq) for r in out] == [("a", 1, 0, 1), ("a", 1, 5, 2), ("a", 2, 1, 3), ("b", 1, 0, 1)]


def test_units_at_restarts() -> None:
    """Units of two bits: a restart after four bytes is not met before it is due, one after three bytes is."""
    one = H.table(bytes([1] + [0] * 15 + [0]))
    ctx = H.Context({(0, 0): one, (1, 0): one}, [(1, 0, 0)])
    assert H.count_units(ctx, bytes(4) + b"\xff\xd0" + bytes(4)) == 32
    assert H.count_units(ctx, bytes(3) + b"\xff\xd0" + bytes(4)) == 12
    assert H.count_units(ctx, bytes(4) + b"\xff\xd9" + bytes(4)) == 16 and H.count_units(ctx, b"") == 0
    assert H.count_units(ctx, b"\xff\xd3" + bytes(2)) == 8 and H.count_units(ctx, b"\x00\xff\x00") == 4
    assert [*H.segments(b"a\xff\x00b\xff\xd0c\xff")] == [(b"a\xffb", 0xD0), (b"c", None), (b"", None)]
