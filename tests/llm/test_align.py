"""Cross-tokenizer alignment against both libraries and all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from bytelode.llm import align, pieces
from tests.llm.data import empty, table, texts

A = Tokenizer.from_file(align.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
ODD = ["▁ mark", "<|endoftext|> <s> </s> <0x41>", "é 漢字 😀‍👩 \x00", "  two  \n\n x\t", " ", "don't 'll 123456", "x" + " " * 300 + "y"]


def tokens(text: str) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
    letters, whole = align.byte_letters(), f" {text}".encode()
    a = [(k, bytes(letters[c] for c in A.id_to_token(k))) for k in A.encode(f" {text}", add_special_tokens=False).ids]
    b = [(k, bytes([int(p[3:5], 16)]) if B.is_byte(k) else p.replace("▁", " ").encode()) for k in B.encode(text) for p in [B.id_to_piece(k)]]
    return (a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def placed(side: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for k, raw in side:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def wanted(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    found = []
    for key, text in rows:
        a, b = map(placed, tokens(text or ""))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [";".join(",".join(str(x[0]) for x in a if lo < x[2] <= hi) + "|" + ",".join(str(y[0]) for y in b if lo < y[2] <= hi) for lo, hi in zip([0, *cuts], cuts, strict=False))]
        found.append((key, len(a), len(b), len(cuts), links, hashlib.sha256(groups[0].encode()).hexdigest() if a else ""))
    count = Counter(p for f in found for p in set(f[4]))
    best: Counter = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(*f[:4], len(f[4]), sum(count[p] == best[p[0]] for p in f[4]), sum(count[p] for p in f[4]), f[5]) for f in found]


@pytest.mark.parametrize("head", [align.HEAD, 40, 0])
def test_report(spark, head: int) -> None:
    rows = [(k, t) for k, t in texts() if len(t or "") < 2500] + [(500 + k, t) for k, t in enumerate(ODD)]
    out = align.report(table(spark, rows), head=head).collect()
    assert sorted(map(tuple, out), key=str) == sorted(wanted(rows), key=str)
    assert align.report(empty(spark), head=head).collect() == []


def test_alignments(spark) -> None:
    rows = [(k, t) for k, t in texts()[:30]] + [(500 + k, t) for k, t in enumerate(ODD)]
    by = {r.doc_id: r for r in align.alignments(table(spark, rows)).collect()}
    for key, text in rows:
        a, b = map(placed, tokens(text or ""))
        r = by[key]
        assert (r.a, r.a_end, r.b, r.b_end) == ([x[0] for x in a], [x[2] for x in a], [x[0] for x in b], [x[2] for x in b])
        assert [*zip(r.link_a, r.link_b, strict=True)] == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        assert r.group_end == sorted({x[2] for x in a} & {y[2] for y in b})


def test_batches_and_long_texts() -> None:
    """A text is aligned alike alone and among others, and a megabyte in one piece."""
    pair, draw = align.load().open(), random.Random(3)
    long = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 12))) for _ in range(150_000))
    given = ["", "one", "▁", "two three", "", "a" * 300_000, long, ""]
    x = align.align(pair, given)
    hashes = align.group_texts(pair, x)
    for k, text in enumerate(given):
        alone = align.align(pair, [text])
        assert [hashes[k]] == align.group_texts(pair, alone)
        lo, hi = x.first(0)[k : k + 2]
        assert x.ids[0][lo:hi].tolist() == alone.ids[0].tolist()
    assert hashes[0] == hashes[2] == "" and x.ids[0][slice(*x.first(0)[6:8])].tolist() == A.encode(f" {long}", add_special_tokens=False).ids
