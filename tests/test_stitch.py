"""Chunks without their images, recovery by ranges, files with a commit, and joins on bins, against the plain way."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from bytelode.operators import intervals, report, scan, select
from bytelode.operators import recover as R
from bytelode.operators.signatures import Signatures
from bytelode.operators.specs import Spec, builtin_specs, select_types, specs_frame
from bytelode.plans.carve import CarveConfig, carve
from bytelode.plans.cli import recover_parser, run_carve, run_recover
from bytelode.plans.cli import parser as carve_parser
from bytelode.sources import images as I
from bytelode.sources import scratch, store
from bytelode.streaming.landing import watch_chunks
from tests.test_carve import image
from tests.test_formats import SOF, SOS, START, TABLES

SPECS = [Spec("Config", "a", b"ab", b"cc?", 40, markers=(b"ba", b"aab")), Spec("Config", "b", b"ba", b"ac", 1 << 20), Spec("Htm", "c", b"ccb", b"AAA", 300, False), Spec("Config", "d", b"?c", b"bbb", 30, True, "Reverse"), Spec("Config", "e", b"abc", b"cab", 60, True, "Ascii")]


def rows(df) -> list[str]:
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [64, 100])
@pytest.mark.parametrize("config", [{}, {"write_all": True}, {"disable_validation": True}])
def test_chunks_without_images(spark, size: int, config: dict) -> None:
    draw = random.Random(size)
    data = [bytes(draw.choice(b"abc") for _ in range(draw.choice([0, 1, 70, 199, 200, 500]))) for _ in range(20)]
    c = CarveConfig(SPECS, chunk_size=size, **config)
    images = image(spark, *data)
    assert rows(carve(images, c)) == rows(carve(None, c, I.chunks(images, size)))


def test_gzip_headers_across_chunks(spark) -> None:
    """What follows a gzip header may be beyond its chunk, as may its name and its footer."""
    draw, c = random.Random(2), CarveConfig(select_types(builtin_specs(), ["gz", "gif", "png"]), chunk_size=70_000)
    data = []
    for k in range(12):
        head = b"\x1f\x8b\x08\x08" + bytes([1, 2, 3, 1]) + b"\0\x03" + b"n" * draw.choice([0, 5, 900, 1500]) + b"\0" + draw.choice([b"\x01\5\0\xfa\xffhello", b"\7\1\1\1\1", b"\3abc"])
        body = bytearray(draw.choice([b"\1", b"\1\2"]) * 150_000)[:150_000]
        for at in (draw.randrange(69_000, 70_000), 69_995 - k, 140_000):
            body[at : at + len(head)] = head
        body[144_000:144_004] = bytes(4 * (k % 3 > 0))
        body[69_990 + k : 69_998 + k] = b"GIF89a\1\1" if k % 2 else bytes(body[69_990 + k : 69_998 + k])
        data.append(bytes(body))
    images = image(spark, *data)
    whole = rows(carve(images, c))
    assert whole == rows(carve(None, c, I.chunks(images, 70_000))) and len(whole) > 3


def test_what_chunks_alone_cannot_tell(spark) -> None:
    images = image(spark, b"ab" + bytes(300))
    with pytest.raises(ValueError, match="needs its image"):
        carve(None, CarveConfig([Spec("Mov", "mov", b"moov", b"end", 99)]), I.chunks(images, 64))
    with pytest.raises(Exception, match="fewer than 64 bytes"):
        carve(None, CarveConfig(SPECS[:1]), I.chunks(images, 20)).collect()


def test_chunks_of_files_in_file_mode(spark, tmp_path) -> None:
    data = b"x" * 90 + b"<html>" + b"a" * 300 + b"</html>" + b"<html>b</html>" + b"c" * 20
    (tmp_path / "disk.img").write_bytes(data)
    spark.dataSource.register(I.ImageChunks)
    chunks = spark.read.format("image_chunks").option("path", str(tmp_path / "disk.img")).option("chunkSize", 100).load()
    got = carve(None, CarveConfig([Spec("Config", "t", b"<html>", b"</html>", 1000)]), chunks).orderBy("seq").collect()
    assert [(r.img_offset, r.filesize, r.seq) for r in got] == [(90, 313, 1), (403, 14, 2)]


@pytest.mark.parametrize("always", [False, True])
def test_selection_in_order(spark, always: bool) -> None:
    draw = random.Random(7)
    table = []
    for k in range(12):
        places = sorted(draw.randrange(200) for _ in range(draw.choice([0, 1, 80])))
        table += [(f"i{k // 3}", k % 3, p, draw.choice([0, 0, 1, 5, 30]), n, False) for n, p in enumerate(places)] + [(f"i{k // 3}", k % 3, 3, 50, -1, True)] * always
    df = spark.createDataFrame(table, "image string, part int, pos long, adv long, n int, odd boolean").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = select.in_order(df, ["image", "part", "odd"], "pos", "adv", "odd").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted, reach = [], {}
    for r in table:
        if r[5] or r[2] >= reach.get(r[:2], 0):
            wanted.append(r)
            if not r[5]:
                reach[r[:2]] = r[2] + r[3]
    assert [tuple(r) for r in found] == wanted


def test_best_points_of_intervals(spark) -> None:
    draw = random.Random(8)
    points = [("i", 8 * k, float(draw.randrange(20))) for k in range(300)] + [("j", 8 * k, 1.0) for k in range(50)]
    spans = []
    for n in range(40):
        lo = draw.randrange(0, 2400)
        skip = draw.randrange(lo, lo + 300)
        spans.append((draw.choice("ijk"), n, lo, lo + draw.choice([0, 5, 100, 900, 2400]), skip, skip + draw.choice([0, 64, 200])))
    p = spark.createDataFrame(points, "image_id string, offset long, entropy double")
    w = spark.createDataFrame(spans, "image_id string, seq int, lo long, hi long, skip_lo long, skip_hi long")
    found = sorted((r.image_id, r.seq, r.rank, r.offset, r.entropy) for r in intervals.best(p, w, ["image_id"], "seq", 3, "entropy", 64).collect())
    wanted = []
    for image_id, n, lo, hi, a, b in spans:
        inside = sorted((-e, o) for i, o, e in points if i == image_id and lo <= o < hi and not a <= o < b)[:3]
        wanted += [(image_id, n, k, o, -e) for k, (e, o) in enumerate(inside, 1)]
    assert found == sorted(wanted)


def broken_image(draw: random.Random) -> bytes:
    head = START + TABLES + SOF + SOS
    return head + draw.randbytes(40) + b"\xff\x11" + draw.randbytes(draw.randrange(900)) + head + draw.randbytes(100) + b"\xff\xd9" + draw.randbytes(300) + b"\xff\xd9"


def test_recovery_by_ranges(spark, tmp_path) -> None:
    """The same images as rows and as files: the same winners, the same bytes, and no bytes of images in an exchange."""
    draw = random.Random(3)
    data = [broken_image(draw) for _ in range(8)]
    paths = [str(tmp_path / f"{k}.img") for k in range(8)]
    for p, d in zip(paths, data, strict=True):
        open(p, "wb").write(d)
    images = spark.createDataFrame([(p, bytearray(d)) for p, d in zip(paths, data, strict=True)], I.IMAGE)
    files = carve(images, CarveConfig(select_types(builtin_specs(), ["jpg"]))).cache()
    for huffman in (False, True):
        c = R.RecoveryConfig(64, 512, 3, 3.0, 0.2, huffman)
        held, ranged = R.recover(images, files, c), R.recover(None, files, c)
        assert rows(held) == rows(ranged) and ranged.count() > 3
        assert rows(R.spliced(images, held)) == rows(R.spliced(None, ranged))
        assert "content" not in ranged._jdf.queryExecution().toString() and "content" not in R.spliced(None, ranged)._jdf.queryExecution().toString()


def test_recovery_ends_on_broken_headers(spark) -> None:
    head = START + TABLES + SOF.replace(b"\1\1\x11\0", b"\1\1\0\0") + SOS
    data = head + bytes(30) + b"\xff\x11" + bytes(range(200)) * 5 + b"\xff\xd9"
    images = image(spark, data)
    files = carve(images, CarveConfig(select_types(builtin_specs(), ["jpg"])))
    assert [r.huffman_mcu_count is not None for r in R.recover(images, files, R.RecoveryConfig(64, 512, 3, 0.0, 0.0)).collect()] in ([True], [])


def test_command_line(spark, tmp_path) -> None:
    (tmp_path / "d.img").write_bytes(broken_image(random.Random(1)))
    out = str(tmp_path / "out")
    assert run_carve(spark, carve_parser().parse_args(["-t", "jpg", "-o", out, str(tmp_path / "d.img")])) == 0
    args = recover_parser().parse_args(["-i", str(tmp_path / "d.img"), "-r", f"{out}/carve_report.json", "-o", str(tmp_path / "again"), "-b", "64", "-w", "512", "--min-entropy", "0"])
    assert run_recover(spark, args) == 0
    assert os.path.exists(tmp_path / "again" / "recover_report.json")


# --- files and ranges ---


def test_files_have_a_commit(spark, tmp_path) -> None:
    """A job that fails leaves no file, neither of the failed task nor of those that had ended."""
    good = spark.createDataFrame([(f"{k}.bin", bytearray(b"x" * k)) for k in range(20)], "filename string, data binary").repartition(4)
    store.write_files(good, str(tmp_path / "good"))
    assert sorted(os.listdir(tmp_path / "good")) == sorted(f"{k}.bin" for k in range(20))
    assert all(os.path.getsize(tmp_path / "good" / f"{k}.bin") == k for k in range(20))
    bad = good.unionAll(spark.createDataFrame([("a/b", bytearray(b"x"))], "filename string, data binary")).coalesce(1)
    bad = good.unionAll(bad.where("filename = 'a/b'"))
    with pytest.raises(Exception, match="not a file name"):
        store.write_files(bad, str(tmp_path / "bad"))
    assert os.listdir(tmp_path / "bad") == []
    store.write_files(good.where("false"), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []


def test_ranges(spark, tmp_path) -> None:
    data = random.Random(1).randbytes(5000)
    (tmp_path / "f").write_bytes(data)
    asked = [(str(tmp_path / "f"), o, n, k) for k, (o, n) in enumerate([(0, 10), (4990, 50), (6000, 5), (100, 0), (-1, 5), (17, 4000)])]
    ranges = spark.createDataFrame(asked, "path string, offset long, length long, k int")
    wanted = [data[o : o + n] if o >= 0 else b"" for _, o, n, _ in asked]
    assert [bytes(r.bytes) for r in store.read_ranges(ranges).orderBy("k").collect()] == wanted
    ranges.write.parquet(str(tmp_path / "table"))
    assert sorted(bytes(r.bytes) for r in store.load_ranges(spark, str(tmp_path / "table")).collect()) == sorted(wanted)
    assert store.read_ranges(ranges.where("false")).count() == 0


def test_scratch_tables_go(spark) -> None:
    folder = scratch.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = spark.createDataFrame([(1, k, 3, k) for k in range(40)], "u long, pos long, len long, e long")
    out = select.greedy_any(df, ["u"], "pos", "len", 10)
    assert out.count() == 14 and len(set(os.listdir(folder)) - before) == 1
    scratch.discard(out)
    assert set(os.listdir(folder)) == before
    with scratch.owned():
        scratch.settle(df)
    assert set(os.listdir(folder)) == before


def test_report_of_ranges(spark, tmp_path) -> None:
    images = image(spark, START + TABLES + SOF + SOS + b"\x12\xff\xd9")
    found = carve(images, CarveConfig(select_types(builtin_specs(), ["jpg"])))
    store.write_files(report.payloads(images, found), str(tmp_path))
    assert os.listdir(tmp_path) == ["1-0.jpg"] and found.select(F.col("filesize")).first()[0] == os.path.getsize(tmp_path / "1-0.jpg")


def test_catalog_in_a_table(spark) -> None:
    """Some thousand signatures, read by the tasks; wildcards, folded case and search types as in a catalog of specs."""
    draw = random.Random(9)
    specs = [Spec("Config", f"s{k}", bytes(draw.choice(b"abcA") for _ in range(draw.randrange(2, 6))) + draw.choice([b"", b"?", b"?a"]), None, 9, draw.random() < 0.7, draw.choice(["Forward", "Ascii"])) for k in range(3000)]
    data = [bytes(draw.choice(b"abcABC") for _ in range(60)) for _ in range(6)] + [b"", None]
    chunks = spark.createDataFrame([(str(k), k, None if d is None else bytearray(d)) for k, d in enumerate(data)], "image_id string, chunk_no int, bytes binary")
    found = scan.places(chunks, specs_frame(spark, specs))
    assert found.columns == ["image_id", "chunk_no", "spec_idx", "pos"]
    got = {(r.image_id, r.spec_idx, r.pos) for r in found.collect()}
    assert got == {(str(k), idx, p) for k, d in enumerate(data) for idx, at in Signatures(specs).places(d or b"").items() for p in at.tolist()} and len(got) > 1000
    counted = {r.spec_idx: r.n_hits for r in scan.tally(chunks, specs_frame(spark, specs)).collect()}
    assert counted == {r.spec_idx: r.n_hits for r in scan.tally(chunks, specs).collect()} and sum(counted.values()) == len(got)


def test_chunks_in_any_batches(spark, tmp_path) -> None:
    """Chunks of several images, shuffled over batches and some of them twice, give what all of them at once give."""
    draw, c = random.Random(4), CarveConfig(SPECS, chunk_size=64)
    data = [bytes(draw.choice(b"abc") for _ in range(draw.choice([30, 200, 500]))) for _ in range(6)]
    images = image(spark, *data)
    rows_ = [(r.image_id, r.chunk_no, r.chunk_offset, r.bytes, r.chunk_offset + len(r.bytes) == len(data[int(r.image_id)])) for r in I.chunks(images, 64).collect()]
    draw.shuffle(rows_)
    schema = "image_id string, chunk_no int, chunk_offset long, bytes binary, last boolean"
    for k in range(4):
        spark.createDataFrame(rows_[k::4] + rows_[:3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch_chunks(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "checkpoint"), c).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch_id")) == rows(carve(images, c))
    assert len(os.listdir(tmp_path / "out")) == 4
