"""Reports over several images, sinks, ordered text, probes and histograms."""

from __future__ import annotations

import json
import os
import random
from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytelode.operators import report, stats
from bytelode.operators.reporter import JsonReporter, PartitionReporter, tell
from bytelode.operators.specs import builtin_specs, select_types
from bytelode.plans.carve import CarveConfig, carve
from bytelode.plans.cli import parser, run_carve
from bytelode.sources import images as I
from bytelode.sources import text
from bytelode.streaming.landing import watch
from tests.test_carve import image
from tests.test_formats import SOF, SOS, START, TABLES, bmp


def carved(spark):
    whole, broken = START + TABLES + SOF + SOS + b"\x12\xff\xd9", START + TABLES + SOF + SOS + b"\x12\xff\x11" + bytes(70)
    images = image(spark, bytes(3) + whole + bytes(5) + broken, b"", bmp() + bmp(), None)
    sources = images.select("image_id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes_read"))
    return images, sources, carve(images, CarveConfig(select_types(builtin_specs(), ["jpg", "bmp"])))


def test_merged_report(spark, tmp_path) -> None:
    """The document that the rows of single images make, put one behind the other; the source is the last image."""
    images, sources, files = carved(spark)
    at = str(tmp_path / "deep" / "carve_report.json")
    assert report.write_merged(sources, files, at) == os.path.getsize(at)
    doc = json.load(open(at))
    single = {r.image_id: report.to_document(r.report) for r in report.reports(images, files).collect()}
    assert doc["fileobjects"] == [o for k in sorted(single) for o in single[k]["fileobjects"]] and len(doc["fileobjects"]) == 4
    assert doc["source"] == single["3"]["source"] and doc["metadata"] == single["0"]["metadata"] and doc["configuration"] == {} and doc["creator"]["package"] == "bytelode"
    assert [r.filesize for r in report.read_report(spark, at).orderBy("seq").collect()] == [o["filesize"] for o in doc["fileobjects"]]
    report.write_merged(sources, files.where("false"), at)
    assert json.load(open(at))["fileobjects"] == [] and os.listdir(tmp_path / "deep") == ["carve_report.json"]


def test_audit_of_images(spark, tmp_path) -> None:
    images, sources, files = carved(spark)
    report.write_audit(sources, files, str(tmp_path / "audit_log.txt"))
    sizes = {r.image_id: r.bytes_read for r in sources.collect()}
    wanted = [line for k in sorted(sizes) for line in report.audit_lines(files.where(F.col("image_id") == k), sizes[k])]
    assert open(tmp_path / "audit_log.txt").read().split("\n") == [*wanted, ""]
    assert wanted[0] == report.AUDIT_HEAD and wanted[1] == "" and wanted[-1] == "Finished carving. Total bytes read: 0"


class Names(PartitionReporter):
    """A sink that counts names where they are."""

    def tell(self, rows: Iterator[pa.RecordBatch]) -> Iterator[str]:
        for batch in rows:
            yield from batch.column("filename").to_pylist()


def test_another_sink(spark, tmp_path) -> None:
    _, sources, files = carved(spark)
    sink = Names()
    tell(sink, sources, files)
    assert sorted(sink.told[0]) == sorted(r.filename for r in files.collect())
    json_sink = JsonReporter(str(tmp_path / "r.json"))
    with pytest.raises(ValueError):
        json_sink.finalize()
    json_sink.initialize(sources)
    for batch in (0, 1, 1):  # a batch that comes again counts once
        json_sink.add(files.where(F.col("image_id") == str(2 * batch)), batch)
    json_sink.finalize()
    assert len(json.load(open(tmp_path / "r.json"))["fileobjects"]) == 4


def test_sink_of_a_stream(spark, tmp_path) -> None:
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.img").write_bytes(bmp() * k)
    sink = Names()
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), CarveConfig(select_types(builtin_specs(), ["bmp"])), 2, sink).awaitTermination()
    assert len(sink.told) == 3 and sum(map(len, sink.told.values())) == 10


def test_probe_and_several_files(spark, tmp_path, capsys) -> None:
    (tmp_path / "a.img").write_bytes(bmp())
    (tmp_path / "b.img").write_bytes(bytes(7) + bmp())
    (tmp_path / "empty.img").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("a.img", "b.img", "empty.img", "missing.img")] + [str(tmp_path)]
    found = {os.path.basename(r.path): (r.size, r.error) for r in I.probe(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert found["a.img"] == (54, None) and found["empty.img"] == (0, None) and found["missing.img"][1] and found[tmp_path.name][1]
    assert run_carve(spark, parser().parse_args(["-t", "bmp", "-j", "2", "-o", str(tmp_path / "out"), *paths])) == 0
    assert "missing.img" in capsys.readouterr().err
    names = os.listdir(tmp_path / "out")
    assert sum(n.endswith(".bmp") for n in names) == 2 and {"audit_log.txt", "carve_report.json"} <= {*names}
    assert len(json.load(open(tmp_path / "out" / "carve_report.json"))["fileobjects"]) == 2
    assert run_carve(spark, parser().parse_args(["-o", str(tmp_path / "none"), str(tmp_path / "missing.img")])) == 0


def test_chunks_of_several_files(spark, tmp_path) -> None:
    for k in range(3):
        (tmp_path / f"{k}").write_bytes(bytes([k]) * (10 * k))
    chunks = I.chunks_of_files(spark, [str(tmp_path / f"{k}") for k in range(3)], 8)
    assert sorted((r.image_id[-1], r.chunk_no, len(r.bytes)) for r in chunks.collect()) == [("1", 0, 8), ("1", 1, 2), ("2", 0, 8), ("2", 1, 8), ("2", 2, 4)]


def test_ordered_text(spark, tmp_path) -> None:
    rows = [(k, f"{k}\n" if k % 7 else None) for k in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, line string").repartition(7)
    at = str(tmp_path / "t")
    for _ in range(2):
        text.write_ordered(df, ["k"], at)
        assert open(at).read() == "".join(f"{k}\n" for k in range(500) if k % 7)
    assert text.write_ordered(df.where("false"), ["k"], at) == 0


def test_counts_of_pieces(spark) -> None:
    draw = random.Random(4)
    data = [draw.randbytes(draw.choice([0, 1, 900])) + b"a" * draw.randrange(200) for _ in range(12)]
    images = image(spark, *data, None)
    whole = {r.image_id: r.entropy for r in stats.entropies(images).collect()}
    for size in (1, 64, 10_000):
        counts = stats.byte_counts(I.chunks(images, size))
        assert {(r.image_id, r.byte): r.n for r in counts.collect()} == {(str(k), b): d.count(b) for k, d in enumerate(data) for b in {*d}}
        found = {r.image_id: r.entropy for r in stats.entropy_of(counts).collect()}
        assert {*found} == {str(k) for k, d in enumerate(data) if d} and all(abs(e - whole[k]) < 1e-9 for k, e in found.items())
