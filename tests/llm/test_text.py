"""Tokenisation, token counts and decontamination against the library, scalar code and round trips."""

from __future__ import annotations

import random
import time

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytelode.llm import decontam, pieces, tokencount
from tests.llm.data import empty, sentence, table, texts

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
ODD = ["  two  spaces\n x\ty 漢😀 ", " ", "   ", " a", "a" * 700, "\u2581", "if x:\n        return    y\n\n\n  z", "ﷺ ﬁ ½ İ", "<s> </s> <0x41>"]


def encode(model: pieces.Model, given_texts: list[str]) -> list[list[int]]:
    ids, at = model.encode(given_texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_same_as_library() -> None:
    given_texts = [t for _, t in texts() if t is not None] + ODD
    assert encode(pieces.load(), given_texts) == LIBRARY.encode(given_texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\u2581\0"), max_size=40), max_size=4))
def test_random_texts(given_texts: list[str]) -> None:
    model = pieces.load()
    assert encode(model, given_texts) == LIBRARY.encode(given_texts)
    ids, at = model.encode(given_texts)
    assert model.decode(ids, at) == given_texts


def test_long_words_that_resemble_each_other() -> None:
    """Words and their complements get their own ids, whatever else is in the batch or was met before."""
    draw = random.Random(7)
    for n in (600, 1024, 4096):
        word = "".join(draw.choice("ab") for _ in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        for batch in ([word, other], [other, word], [word], [other], [word, other + "x", other, word + "y", f"{word} {other}"]):
            assert encode(pieces.load(), batch) == LIBRARY.encode(batch)
    for text in ("a" * 200_000, "漢字" * 20_000, "".join(draw.choice("abcdefgh") for _ in range(100_000))):
        assert encode(pieces.load(), [text]) == [LIBRARY.encode(text)]


def test_unigram_scores() -> None:
    """Of a unigram model the best total score, by trying all cuts."""
    model = pieces.Model(["<unk>", "\u2581a", "b", "ab", "\u2581", "a", "ba", "bab"], np.array([0, -1.0, -2.0, -1.5, -1.0, -2.5, -2.2, -4.0]), [], [0], False)

    def best(word: str) -> float:
        cuts = [model.scores[model.place[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in model.place]
        return max(cuts, default=-np.inf) if word else 0.0

    draw = random.Random(1)
    for _ in range(50):
        batch = ["".join(draw.choice("ab") for _ in range(draw.randint(1, 9))) for _ in range(draw.choice([1, 40]))]
        for text, ids in zip(batch, encode(model, batch), strict=True):
            assert np.isclose(model.scores[ids].sum(), best("\u2581" + text))


def test_encoding_of_tables(spark) -> None:
    rows = texts() + [(900 + k, t) for k, t in enumerate(ODD)]
    out = pieces.encode(table(spark, rows)).cache()
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and by[0].ids == [] and by[0].round_trip and by[905].round_trip is False
    assert all(r.n_tokens == len(r.ids) for r in by.values())
    back = {r.doc_id: r.text for r in pieces.decode(out.where("round_trip and doc_id is not null")).collect()}
    assert all(back[k] == (t or "") for k, t in rows if k in back)
    assert pieces.encode(empty(spark)).count() == 0


def test_token_counts(spark) -> None:
    rows = texts()
    coder = tokencount.encoding()
    wanted = sorted(((k, len(coder.encode_ordinary(t or ""))) for k, t in rows), key=str)
    for block in (7, 64, tokencount.BLOCK):
        out = tokencount.count(table(spark, rows), block=block).collect()
        assert sorted(((r.doc_id, r.n_tokens) for r in out), key=str) == wanted
    assert tokencount.count(empty(spark)).count() == 0


def test_flat_files(spark, tmp_path) -> None:
    """Files from outside: documents across blocks, empty ones, and one without an end."""
    end = tokencount.END
    tokens = np.array([1, 2, end, end, *range(10, 30), end, 5], "<u2")
    (tmp_path / "a.bin").write_bytes(tokens.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    out = tokencount.scan(tokencount.read_files(spark, str(tmp_path), 4), end, 4).orderBy("doc_no").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in out] == [(0, 2, True), (3, 0, True), (4, 20, True), (25, 1, False)]


def distance(item: str, text: str) -> int:
    """Least edit distance of item to any substring of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row[0] = row[:], i
        for j, d in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != d))
    return min(row)


def test_decontamination(spark) -> None:
    draw = random.Random(4)
    items = [(k, sentence(draw, 25)) for k in range(6)] + [(6, None), (7, "  "), (8, "tiny"), (None, sentence(draw, 20))]
    rows: list[tuple] = [(0, None), (1, ""), (2, sentence(draw, 60)), (3, "has tiny in it")]
    for k, text in items[:6]:
        for edits in (0, 2, len(text) // 20, len(text) // 20 + 3, 30):
            chars = list(text)
            for at in draw.sample(range(len(chars)), edits):
                chars[at] = draw.choice(["", "q", chars[at] + "q"])
            rows.append((len(rows), f"{sentence(draw, 5)}\n{''.join(chars).upper()} {sentence(draw, 5)}"))
    rows.append((99, f"{items[0][1]} and {items[1][1]}"))
    wanted = {(d, k, n) for d, t in rows if t for k, i in items if i and i.strip() for n in [distance(decontam.normal(i), decontam.normal(t))] if n <= len(decontam.normal(i)) // 20}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (decontam.BLOCK_CHARS, 100):
        assert {tuple(r) for r in decontam.leaks(table(spark, rows), bench, chars).collect()} == wanted
        kept = decontam.clean(table(spark, rows), bench, chars)
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _, _ in wanted}
    assert decontam.leaks(empty(spark), bench).count() == 0
    assert decontam.clean(table(spark, rows), bench.where(F.lit(False))).count() == len(rows)


def test_long_runs_of_white_space() -> None:
    coder = tokencount.encoding()
    for text in ("  a   b", "x\n\n\n\ny", "   ", "a    ", "\t\t\t1  　　 z", "\x1c\x1c\x1c\x1c x", "", "a   'll   '   ü"):
        assert tokencount.encode(coder, text, 2).tolist() == coder.encode_ordinary(text)
    assert len(tokencount.encode(coder, " " * 1_000_000)) == len(coder._encode_single_piece(b" " * 1_000_000))
    assert len(tokencount.encode(coder, "a" + " " * 1_000_000 + "b")) > 2
    for n in (99, 100, 101):
        text = ("x" + " " * n) * 20
        assert tokencount.encode(coder, text).tolist() == coder.encode_ordinary(text)
    before = time.process_time()
    assert len(tokencount.encode(coder, ("x" + " " * 9_999) * 100)) > 200
    assert time.process_time() - before < 10
