"""Whole carves, recovery, reports and the landing folder, on images built in code."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from bytelode.functions import walkers as W
from bytelode.operators import recover as R
from bytelode.operators import report, scan, stats
from bytelode.operators.specs import Spec, builtin_specs, select_types
from bytelode.plans.carve import CarveConfig, carve
from bytelode.plans.cli import parser, run_carve
from bytelode.sources import images as I
from bytelode.streaming.landing import watch
from tests.test_formats import SOF, SOS, START, TABLES, bmp


def image(spark, *contents: bytes | None):
    return spark.createDataFrame([(str(k), None if c is None else bytearray(c)) for k, c in enumerate(contents)], I.IMAGE)


def files(spark, data: list[bytes], types: list[str], **config) -> list[list[tuple]]:
    """For each image its files, from one carve of them all."""
    rows = carve(image(spark, *data), CarveConfig(select_types(builtin_specs(), types), **config)).orderBy("seq").collect()
    return [[(r.file_type, r.img_offset, r.filesize) for r in rows if r.image_id == str(k)] for k in range(len(data))]


def put(size: int, **at: bytes) -> bytes:
    out = bytearray(size)
    for k, v in at.items():
        out[int(k[1:]) : int(k[1:]) + len(v)] = v
    return bytes(out)


def test_sizes_and_suppression(spark) -> None:
    gif = b"GIF89a\1\0\1\0"
    plain = bytearray(b"\x55" * 300)
    for at, value in ((0, gif), (70, b"\0\0;"), (50, gif), (60, b"\0\0;"), (150, gif), (200, b"\0\0;")):
        plain[at : at + len(value)] = value
    jpeg = put(500, _0=b"\xff\xd8\xff\xe0", _100=b"\xff\xd8\xff\xe0", _150=b"\xff\xd9", _300=b"\xff\xd9")
    mz = put(1024, _0=b"MZ")
    # a gzip member without time stamp has its footer inside its header; tags fold case
    gz = bytes.fromhex("1F8B08000000000000FF") + b"\1\5\0\xfa\xffhello" + bytes(8)
    data = [bytes(1024), put(1024, _100=b"\xff\xd8\xff\xe0", _200=b"\xff\xd9"), bytes(plain), jpeg, mz, bmp() + bytes(10), gz, b"..<HTML>x</Html>..<html>"]
    wanted = [[], [("jpeg", 100, 102)], [("gif", 0, 63), ("gif", 150, 53)], [("jpeg", 0, 152), ("jpeg", 100, 52)], [], [("bmp", 0, 54)], [], [("htm", 2, 14), ("htm", 18, 6)]]
    assert files(spark, data, ["jpg", "gif", "exe", "bmp", "gz", "htm"]) == wanted
    assert files(spark, [mz], ["exe"], disable_validation=True) == [[("exe", 0, 1024)]] == files(spark, [mz], ["exe"], write_all=True)


def test_order_chunks_and_bridges(spark) -> None:
    """Hits that wait for a footer beyond their chunk come last and are measured on the image."""
    data = b"<html>" + b"a" * 30 + b"<html>b</html>" + b"c" * 20
    got = carve(image(spark, data), CarveConfig([Spec("Config", "t", b"<html>", b"</html>", 1000)], chunk_size=36)).orderBy("seq").collect()
    assert [(r.img_offset, r.filesize, r.seq) for r in got] == [(0, 50, 1), (36, 14, 2)]
    got = carve(image(spark, data), CarveConfig([Spec("Config", "t", b"<html>", b"</html>", 1000)], chunk_size=36, mode="buffer")).orderBy("seq").collect()
    assert [(r.img_offset, r.filesize) for r in got] == [(0, 36), (36, 14)]
    two = CarveConfig([Spec("Config", "a", b"AA", None, 3), Spec("Htm", "h", b"hh", None, 4, False)])
    assert [r.suffix for r in carve(image(spark, b"HHxxAA.hh"), two).orderBy("seq").collect()] == ["a", "h", "h"]


def test_nulls_empty_and_many_images(spark) -> None:
    got = carve(image(spark, None, b"", bmp(), bmp() + bmp()), CarveConfig(select_types(builtin_specs(), ["bmp"]))).orderBy("image_id", "seq").collect()
    assert [(r.image_id, r.seq, r.filename) for r in got] == [("2", 1, "1-0.bmp"), ("3", 1, "1-0.bmp"), ("3", 2, "2-54.bmp")]


def greedy_by_hand(data: bytes, specs: list[Spec]) -> list[tuple]:
    """A slow, separate count of one image's files for footer specs without checks."""
    out = []
    for s in specs:
        at = 0
        while 0 <= (at := data.find(s.header, at)) <= len(data):
            end = data.find(s.footer, at)
            size = end - at + len(s.footer) if end >= 0 else min(s.max_len, len(data) - at)
            out.append((s.suffix, at, size))
            at += size
    return sorted(out)


def test_random_images_against_plain_search(spark) -> None:
    draw = random.Random(5)
    specs = [Spec("Config", "a", b"ab", b"cc", 9), Spec("Config", "b", b"ba", b"ac", 1 << 20), Spec("Config", "c", b"ccb", b"a", 7)]
    data = [bytes(draw.choice(b"abc") for _ in range(200)) for _ in range(20)]
    got = carve(image(spark, *data), CarveConfig(specs, "buffer")).collect()
    for k, d in enumerate(data):
        assert sorted((r.suffix, r.img_offset, r.filesize) for r in got if r.image_id == str(k)) == greedy_by_hand(d, specs)


def recovery(spark, data: bytes, header: int, length: int, frag: int | None, status: str):
    run = [(0, header, length)]
    scan_info = (8, 8, frag, False, status)
    files = spark.createDataFrame([("0", 1, "1-0.jpg", length, "jpeg", run, scan_info)], f"image_id string, seq int, filename string, filesize long, file_type string, byte_runs array<{report.RUN}>, jpeg_scan {report.SCAN}")
    return R.recover(image(spark, data), files, R.RecoveryConfig(64, 512, 3, 0.0, 0.0, False)).collect()


def test_recovery(spark) -> None:
    direct = bytearray(1024)
    direct[:64] = b"\xff\xd8\xff\xe0" + bytes(k % 251 for k in range(4, 64))
    direct[64:126] = bytes((7 * k + 13) % 251 for k in range(62))
    direct[126:128] = b"\xff\xd9"
    got = recovery(spark, bytes(direct), 0, 64, None, "truncated")
    assert [(r.recovery_method, r.continuation_img_offset, r.recovered_size, r.recovered_filename) for r in got] == [("direct_continuation", 64, 128, "1-0_recovered.jpg")]
    other = bytearray(512)
    other[:64] = direct[:64]
    other[128:190] = bytes((11 * k + 7) % 251 for k in range(62))
    other[190:192] = b"\xff\xd9"
    got = recovery(spark, bytes(other), 0, 64, 64, "fragmented")
    assert [(r.recovery_method, r.continuation_img_offset) for r in got] == [("fragment_reassembly", 128)]
    assert recovery(spark, bytes(1024), 0, 64, None, "truncated") == []
    assert recovery(spark, bytes(direct), 0, 2, None, "truncated") == []
    assert recovery(spark, bytes(direct), 0, 64, None, "complete") == []


def test_spliced_bytes_and_block_validity(spark) -> None:
    data = b"\xff\xd8" + bytes(range(1, 63)) + b"abc\xff\xd9rest"
    won = spark.createDataFrame([("0", 0, 64, 64, 69), ("0", 0, 64, 64, 40)], "image_id string, header_img_offset long, fragment_len long, continuation_img_offset long, recovered_size long")
    assert [bytes(r.data) for r in R.spliced(image(spark, data), won).orderBy("recovered_size").collect()] == [data[:40], data[:69]]
    draw = random.Random(3)
    for _ in range(300):
        d = bytes(draw.choice([255, 255, 0, 0xD9, 0xD3, 17]) for _ in range(draw.randrange(1, 90)))
        starts = np.array(sorted(draw.randrange(len(d)) for _ in range(draw.randrange(6))), np.int64)
        assert R.block_validity(d, starts, 9).tolist() == [W.ff_validity(d[k : k + 9]) for k in starts]


def test_hits_share_what_the_chunk_holds(spark) -> None:
    """Facts of hits in one chunk are those of a chunk that starts at the hit."""
    atom = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    draw = random.Random(8)
    parts = [b"PK\x03\x04" + bytes(14) + (9).to_bytes(4, "little") + bytes(8), b"PK\x05\x06" + bytes(18), b"%PDF-1 ", b"startxref\n3\n%%EOF\n", b"xref", b"\x1f\x8b\x08\0" + bytes(5) + b"\3" + bytes(9), b"\0\0\1\xba!", b"\0\0\1\xb9", atom(b"moov", atom(b"free", b"")), bytes(12), b"trailer /Length"]
    for s in select_types(builtin_specs(), ["zip", "pdf", "gz", "mpg", "mov"]):
        for _ in range(60):
            data = b"".join(draw.choice(parts) for _ in range(draw.randrange(1, 12)))
            for hit in scan.chunk_hits(data, [s]):
                assert scan.chunk_hits(data[hit[1] :], [s]).__next__()[5:] == hit[5:]


def test_jpeg_report_round_trip(spark, tmp_path) -> None:
    whole = START + TABLES + SOF + SOS + b"\x12\xff\xd9"
    broken = START + TABLES + SOF + SOS + b"\x12\xff\x11" + bytes(70)
    images = image(spark, bytes(3) + whole + bytes(5) + broken, b"")
    found = carve(images, CarveConfig(select_types(builtin_specs(), ["jpg"])))
    doc = {r.image_id: r.report for r in report.reports(images, found).collect()}
    assert report.to_document(doc["1"])["fileobjects"] == []
    at = report.write_report(doc["0"], str(tmp_path))
    objects = json.load(open(at))["fileobjects"]
    assert [o["jpeg_scan"]["status"] for o in objects] == ["complete", "fragmented"] and objects[0]["jpeg_scan"]["fragmentation_point_img_offset"] is None
    back = report.read_report(spark, at).orderBy("seq").collect()
    assert [(b.filename, b.filesize) for b in back] == [(o["filename"], o["filesize"]) for o in objects]
    broken_at = W.jpeg(broken, 1 << 20).broken
    assert back[1].jpeg_scan.fragmentation_point_img_offset == 3 + len(whole) + 5 + broken_at
    assert report.audit(found).count() == 2 and report.found_counts(found).first()["found"] == 2
    assert [r.n_files for r in report.summary(images, found).orderBy("image_id").collect()] == [2, 0]


def test_files_skip_and_quick(spark, tmp_path) -> None:
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "disk.img").write_bytes(bytes(512) + bmp())
    images = I.from_files(spark, str(tmp_path / "in"))
    config = CarveConfig(select_types(builtin_specs(), ["bmp"]), quick=True)
    assert [r.img_offset for r in carve(images, config).collect()] == [512]
    assert [r.img_offset for r in carve(I.skip_blocks(images, 1), config).collect()] == [0]
    spark.dataSource.register(I.ImageChunks)
    chunks = spark.read.format("image_chunks").option("path", str(tmp_path / "in" / "disk.img")).option("chunkSize", 512).load()
    assert [(r.chunk_no, r.chunk_offset, len(r.bytes)) for r in chunks.orderBy("chunk_no").collect()] == [(0, 0, 512), (1, 512, 54)]
    assert [r.img_offset for r in carve(images, CarveConfig(config.specs, "buffer"), chunks).collect()] == [512]
    args = parser().parse_args(["-t", "bmp", "-o", str(tmp_path / "out"), str(tmp_path / "in" / "disk.img"), str(tmp_path / "missing")])
    assert run_carve(spark, args) == 0
    assert (tmp_path / "out" / "disk_img-1-512.bmp").read_bytes() == bmp() or list((tmp_path / "out").glob("*1-512.bmp"))
    watch(spark, str(tmp_path / "in"), str(tmp_path / "rows"), str(tmp_path / "cp"), config).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1


def test_entropy_and_blocks(spark) -> None:
    e = {r.image_id: r.entropy for r in stats.entropies(image(spark, b"\7" * 256, bytes(range(256)), b"", None)).collect()}
    assert e == {"0": 0.0, "1": 8.0, "2": 0.0, "3": 0.0}
    assert [r.offset for r in stats.top_blocks(stats.entropies(image(spark, bytes(range(8)) + bytes(8) + bytes(range(8))), 8), 2).orderBy("rank").collect()] == [0, 16]
    assert image(spark, b"ab..AB").select(scan.block_hits(F.col("content"), b"ab", 2, False)).first()[0] == [0, 4]
