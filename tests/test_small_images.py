"""Many small images take the steps of one large one, and nothing is found across two of them."""

from __future__ import annotations

import pyarrow as pa
import pytest

from bytelode.functions import walkers as W
from bytelode.operators import scan
from bytelode.operators.signatures import Signatures
from bytelode.operators.specs import Spec, builtin_specs

SPECS = [*builtin_specs(), Spec("Config", "any", b"a?c", None, 10), Spec("Config", "asc", b"abc", None, 10, search_type="Ascii")]
PIECES = [b"", b"xxBM", b"BMB", b"MZ\x89PNG", b"\r\n\x1a\n", b"", b"abcaxc\xff\xd8\xff\xff\xd8\xff", b"<HTML<html", b"a", b"bc", b""]


@pytest.mark.parametrize("quick", [0, 2])
def test_places_of_pieces_are_those_of_each(quick: int) -> None:
    signatures = Signatures(SPECS)
    wanted = [{k: at.tolist() for k, at in signatures.places(p, quick).items()} for p in PIECES]
    assert signatures.places_of(PIECES, quick) == wanted


@pytest.mark.parametrize("images", [True, False])
def test_small_images_are_searched_together(monkeypatch, images: bool) -> None:
    calls, find = [], Signatures.find
    monkeypatch.setattr(Signatures, "find", lambda self, data: calls.append(len(data)) or find(self, data))
    ids, data = pa.array([str(k) for k in range(500)]), pa.array([b"BM" + bytes(90)] * 500, pa.binary())
    if images:
        run, batch = scan._run_images(SPECS, 0, 1 << 20), pa.RecordBatch.from_arrays([ids, data], ["image_id", "content"])
    else:
        zero = pa.array([0] * 500)
        run, batch = scan._run(SPECS, 0, False), pa.RecordBatch.from_arrays([ids, zero, zero, data], ["image_id", "chunk_no", "chunk_offset", "bytes"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 500
    assert calls == [500 * 92]


def test_marks_of_short_data_are_those_of_long() -> None:
    data = bytes.fromhex("FFFFD9FF00FFD0FFD7FFC4FF") * 3
    short, long = W.JpegMarks(data), W.JpegMarks(data + bytes(W.SHORT))
    last = len(data) - 1  # FF at the very end has no second byte there, and a 0 here
    assert (short.ends, short.restarts, short.broken) == (long.ends, long.restarts, long.broken) and last not in short.broken
