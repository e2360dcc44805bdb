"""Every stage of the pipeline against brute force, each on what the one before kept."""

from __future__ import annotations

import random

import sentencepiece

import corpus_pipeline
from bytelode.llm import decontam, pieces, quality_model, suffixes
from bytelode.llm.common import read
from tests.llm.data import sentence, table, texts
from tests.llm.test_duplicates import linked, shingle_set
from tests.llm.test_text import distance

SF = "/root/testdata/sf0.01"


def without_repeats(given: list[str]) -> list[str]:
    """Each text without the bytes of strings of 200 bytes that start more than once; characters that lose a byte go whole."""
    data, n = [t.encode() for t in given], suffixes.LENGTH
    seen: dict[bytes, int] = {}
    for d in data:
        for k in range(len(d) - n + 1):
            seen[d[k : k + n]] = seen.get(d[k : k + n], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - n + 1):
            if seen[d[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_stages(spark) -> None:
    draw = random.Random(12)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shared = sentence(draw, 60)
    rows = {k: t for k, t in texts() if k is not None and t is not None and len(t) < 3000}
    rows |= {1000 + k: f"{sentence(draw, 40)} {shared} {sentence(draw, 40)}" for k in range(4)}
    rows |= {1100 + k: f"{sentence(draw, 6)} {items[k]} {sentence(draw, 6)}" for k in range(3)}
    stages = dict(corpus_pipeline.STAGES)
    given = table(spark, list(rows.items()))
    kept = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = quality_model.train(docs, read(spark, SF, "labels"))
    good = {r.doc_id for r in quality_model.score(docs, trees).where("score >= 0.7").collect()}
    out = stages["quality"](spark, docs, SF)
    assert out.columns == docs.columns and kept(out) == {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}

    out = stages["near_duplicates"](spark, given, SF)
    ids = sorted(rows)
    roots = linked([shingle_set(rows[k], 5) for k in ids], 80)
    wanted = {k: rows[k] for n, k in enumerate(ids) if roots[n] == n}
    assert out.columns == given.columns and kept(out) == wanted and {*range(1000, 1004), *range(1100, 1103)} <= {*wanted}

    given, ids = table(spark, list(wanted.items())), sorted(wanted)
    out = stages["repeated_passages"](spark, given, SF)
    wanted = dict(zip(ids, without_repeats([wanted[k] for k in ids]), strict=True))
    assert out.columns == given.columns and kept(out) == wanted and not any(shared in t for t in wanted.values())
    assert all(r.n_chars == len(wanted[r.doc_id]) for r in out.collect())

    given = table(spark, list(wanted.items()))
    out = stages["decontamination"](spark, given, SF)
    near = [decontam.normal(i) for i in items[:3]]
    dirty = {k for k in wanted if k >= 1100 for i in near if distance(i, decontam.normal(wanted[k])) <= len(i) // 20}
    assert out.columns == given.columns and dirty == {1100, 1101, 1102} and kept(out) == {k: t for k, t in wanted.items() if k not in dirty}

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    left = {k: t for k, t in wanted.items() if k not in dirty}
    found = stages["encoding"](spark, table(spark, list(left.items())), SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids) for r in found} == {k: (len(i), i) for k, t in left.items() for i in [library.encode(t)]}
