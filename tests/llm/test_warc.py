"""WARC archives: round trips against SQL and plain code, records from elsewhere, and archives that are broken."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytelode.llm import queries, warc
from tests.duck import connect, same

SF = "/root/testdata/sf0.01"
if not os.path.isdir(SF):
    SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, path string, digest string"


def table(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, "p", "d") for r in rows], PAGES).repartition(3)


def corpus() -> list[tuple]:
    draw = random.Random(1)
    page = lambda n: "".join(draw.choice("<p> é漢\r\n") for _ in range(n))
    shared = page(500)
    rows = [(k, f"http://h/{k}", page(draw.randint(0, 300))) for k in range(30)]
    rows += [(100 - k, "http://s/\r\nX-Bad: 1", shared) for k in range(20)] + [(None, None, shared), (81, "again", shared), (81, "again", shared)]
    rows += [(200, None, None), (201, "", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", "x" * 100), (205, "u", "x" * 100), (206, "u", "y" * 99), (207, "u", "y" * 99), (None, "u", "z" * 200), (None, "u", "z" * 200)]
    return rows + [(300, "long", "ab\n" * 700_000), (301, "long", "ab\n" * 700_000), (302, "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9)]


def wanted(rows: list[tuple]) -> list[tuple]:
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and (h or "").encode() == data), default=None)
        revisits = len(data) >= 100 and first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisits else "response", first if revisits else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [warc.ROLL, 2000, 0])
def test_round_trip(spark, roll: int) -> None:
    rows = corpus()
    assert sorted(map(tuple, warc.round_trip(table(spark, rows), roll).collect()), key=str) == wanted(rows)
    assert warc.round_trip(table(spark, []), roll).collect() == []


def test_sql(spark) -> None:
    wanted_rows = connect(SF).sql(f"select * replace (coalesce(refers_to, -1) as refers_to) from ({queries.ORACLES['op13_warc']})").df()
    same(queries.op13_warc(spark, SF).fillna(-1, ["refers_to"]), wanted_rows)


def test_payloads_and_manifest(spark, tmp_path) -> None:
    rows = corpus()
    manifest = warc.write(table(spark, rows), str(tmp_path), 5000).collect()
    assert len(manifest) > 5 and sum(r.records for r in manifest) == len(rows)
    assert all(os.path.getsize(r.path) == r.bytes for r in manifest)
    found = warc.read(warc.paths(spark, [r.path for r in manifest]), payloads=True, tasks=2).where("record_type = 'response'").collect()
    held = {r.record_id.rpartition(":")[2]: r.payload.decode() for r in found}
    assert held["5"] == rows[5][2] and held["300"] == rows[-3][2] and held["200"] == ""
    for r in found:  # every record is a gzip member of its own
        with open(r.path, "rb") as f:
            f.seek(r.offset)
            assert next(warc.records(f)).fields["warc-record-id"] == f"<{r.record_id}>"


def foreign(compressed: bool) -> bytes:
    """Records as other programs write them: folded lines, base 32, other digests, no digest, no HTTP header."""
    body = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\npayload"
    sha1 = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    parts = [
        f"WARC/1.0\r\nwarc-type: response\r\nWARC-Payload-Digest: sha1:{sha1}\r\nContent-Type: application/http;\r\n\tmsgtype=response\r\ncontent-length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Block-Digest: md5:00\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n",
    ]
    return b"".join(map(gzip.compress, parts)) if compressed else b"".join(parts)


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("block", [1, 7, warc.BLOCK])
def test_foreign_records(compressed: bool, block: int) -> None:
    found = list(warc.records(io.BytesIO(foreign(compressed)), True, block))
    assert [(r.fields["warc-type"], r.payload, r.payload_bytes, r.verified) for r in found] == [("response", b"payload", 7, True), ("metadata", b"a: b", 4, None), ("resource", b"", 0, None), ("resource", b"hi", 2, False)]
    assert found[0].payload_digest == hashlib.sha1(b"payload").hexdigest()
    for r in found:
        assert next(warc.records(io.BytesIO(foreign(compressed)[r.offset :]))).fields == r.fields


def test_broken_archives(spark, tmp_path) -> None:
    whole = foreign(True)
    broken = {"cut": whole[:-12], "noise": whole + b"\x1f\x8bnoise that is none", "no_length": gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"), "text": b"hello\r\n", "long": gzip.compress(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort"), "empty": b"", "half": foreign(False)[:20]}
    for name, data in broken.items():
        (tmp_path / name).write_bytes(data)
    found = warc.read(warc.paths(spark, [str(tmp_path / n) for n in broken])).collect()
    errors = {r.path.rpartition("/")[2]: r.error for r in found if r.error}
    assert sorted(errors) == sorted(set(broken) - {"empty"})
    assert sum(r.record_type is not None for r in found) == 3 + 4
    assert "gzip member" in errors["cut"] and "block" in errors["long"] and "content-length" in errors["no_length"]


def test_changed_bytes_are_noticed() -> None:
    data = bytearray(gzip.decompress(warc.record(1, "u", b"some payload", hashlib.sha256(b"some payload").hexdigest(), None)))
    (sound,) = warc.records(io.BytesIO(bytes(data)))
    data[data.index(b"some payload")] ^= 1
    (changed,) = warc.records(io.BytesIO(bytes(data)))
    assert sound.verified is True and changed.verified is False


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=8), st.integers(1, 600))
def test_any_payload(payloads: list[bytes], block: int) -> None:
    data = b"".join(warc.record(k, None, p, hashlib.sha256(p).hexdigest(), None) for k, p in enumerate(payloads))
    assert [(r.payload, r.verified) for r in warc.records(io.BytesIO(data), True, block)] == [(p, True) for p in payloads]
