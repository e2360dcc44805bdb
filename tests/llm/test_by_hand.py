"""Features and decoding against plain code, character by character, and texts of a megabyte through the operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from bytelode.llm import decontam, jaccard, kernels, langid, pieces, quality_model, quality_rules, suffixes, tokencount, urlfilter
from tests.llm.data import sentence, table, texts
from tests.llm.test_models import base

ODD = ["", " \n\t", "a", "A b! c? |x| 1.5,\n#$ %&\n\n#$ %&\n<i>", "é 漢字 😀 \x0b tail", "same same same same\n" * 4]


def flat(given: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets, as kernels take them."""
    data = [t.encode() for t in given]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def entropy(data: bytes) -> float:
    return sum(-n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())


def test_quality_features() -> None:
    given = ODD + [t for _, t in texts() if t is not None]
    found = quality_model.features(*flat(given))
    for row, t in zip(found, given, strict=True):
        n_words, word_chars, n_symbols, n_dup, n_repeat, _ = base(t)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n_lines = sum(1 for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        w, c, lines = max(n_words, 1), max(len(t), 1), max(n_lines, 1)
        of = lambda chars: sum(x in chars for x in t) / c  # noqa: E731, B023
        shares = [of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("0123456789"), of("!?"), of("|"), of(".,;:"), of("#*$%&<>")]
        wanted = [math.log1p(len(t)), math.log1p(n_words), word_chars / w, n_symbols / w, n_dup / lines, n_repeat / w, len(set(words)) / w, n_words / lines, len(t.encode()) / c, entropy(t.encode()), *shares]
        assert np.allclose(row, wanted), t


def test_language_features_and_decoding() -> None:
    given = ODD + [t for _, t in texts()[3:12] if t is not None]
    found = langid.ngrams(*flat(given))
    for row, t in zip(found, given, strict=True):
        low = bytes(32 if x in b" \t\n\x0b\x0c\r0123456789" else x + 32 if 65 <= x <= 90 else x for x in t.encode())
        counted = np.zeros(langid.WIDTH)
        for n in (2, 3):
            for k in range(len(low) - n + 1):
                counted[(int.from_bytes(low[k : k + n], "big") * 2654435761 & 0xFFFFFFFF) >> 21] += 1
        wanted = np.sqrt(counted) / max(math.sqrt(counted.sum()), 1e-9)
        assert np.allclose(row, wanted, atol=1e-5), t
    draw = np.random.default_rng(2)
    code = langid.codebook(5)
    model = langid.Model(list("abcde"), code, draw.normal(size=(langid.WIDTH, code.shape[1])), draw.normal(size=code.shape[1]))
    best, share = model.decode(found)
    for k, x in enumerate(found):
        f = [float(x @ model.weight[:, j] + model.bias[j]) for j in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-c * v)) for c, v in zip(word, f, strict=True)) for word in code]
        assert best[k] == loss.index(min(loss)) and np.isclose(share[k], math.exp(-min(loss)) / sum(math.exp(-v) for v in loss))


def test_lexical_features_of_urls() -> None:
    urls = ["", "http://a-b.example.org/x/12?q=1&r=%20#top", "é://ü_/", "no scheme 7"]
    for row, u in zip(urlfilter.lexical(*flat(urls), np.arange(len(urls)) / 10), urls, strict=True):
        d, n = u.encode(), max(len(u.encode()), 1)
        of = lambda chars: sum(x in chars for x in d)  # noqa: E731, B023
        letters = sum(chr(x).isalpha() for x in d if x < 128)
        wanted = [len(d), of(b"/"), of(b"0123456789"), of(b"0123456789") / n, entropy(d), of(b"&?"), of(b"="), of(b"#"), of(b"."), of(b"-_"), of(b"%"), letters / n]
        assert np.allclose(row[:-1], wanted) and row[-1] == urls.index(u) / 10


@pytest.fixture(scope="module")
def long_texts() -> list[tuple[int, str]]:
    draw = random.Random(6)
    prose = sentence(draw, 250_000)
    return [(0, " " * 1_000_000), (1, "a" * 1_000_000), (2, prose), (3, prose), (4, sentence(draw, 250_000))]


def test_long_texts_are_counted_whole(long_texts: list[tuple[int, str]]) -> None:
    stats = kernels.text_stats(*flat([t for _, t in long_texts]))
    for k, t in long_texts:
        n_words, word_chars, n_symbols, n_dup, n_repeat, _ = base(t)
        assert [int(stats[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [n_words, word_chars, n_symbols, n_dup, n_repeat]


def test_long_texts_in_tables(spark, long_texts: list[tuple[int, str]]) -> None:
    docs = table(spark, long_texts)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(docs).collect()) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 4)]
    nothing = hashlib.sha256(b"").hexdigest()
    left = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixes.report(docs).collect()}
    for k, t in long_texts:
        assert left[k] == ((0, hashlib.sha256(t.encode()).hexdigest()) if k == 4 else (len(t), nothing))
    labels = spark.createDataFrame([(4, 1, 0), (2, 0, 0)], "doc_id long, quality long, toxic long")
    assert quality_model.score(docs, quality_model.train(docs, labels)).count() == quality_rules.judge(docs, labels).count() == 5
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()} == {"und", "xx"}
    prose = docs.where("doc_id in (0, 4)")
    by = dict(long_texts)
    item = by[4][700_000:700_200]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontam.leaks(prose, bench).collect()] == [(4, 9)]
    coder = tokencount.encoding()
    assert {r.doc_id: r.n_tokens for r in tokencount.count(prose).collect()}[4] == len(coder.encode_ordinary(by[4]))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {r.doc_id: r.ids for r in pieces.encode(prose).collect()}[4] == library.encode(by[4])
