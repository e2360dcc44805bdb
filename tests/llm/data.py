"""Small tables with everything that operators must bear: nulls, empty and long texts, repeats, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, spans string, node long, keys string, score double"
VOCABULARY = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu ka ke ki ko ku la le li lo lu".split()


def sentence(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choices(VOCABULARY, k=draw.randint(1, 3))) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    draw = random.Random(seed)
    out: list[str | None] = [None, "", " \t\n", "one", "One  TWO", "ünï cödé ¡hola! 漢字"]
    for n in (12, 40, 80, 150):
        base = sentence(draw, n)
        out += [base, base, base.upper()]
        words = base.split()
        for edits in (1, 2, 4, 8):
            for _ in range(3):
                near = list(words)
                for k in draw.sample(range(n), min(edits, n)):
                    near[k] = "x" + near[k]
                out.append(" ".join(near))
    shared = sentence(draw, 70)
    out += [f"{sentence(draw, 20)} {shared} {sentence(draw, 20)}" for _ in range(8)]
    out += ["line of text\n" * 40, "ab" * 3000, sentence(draw, 4000)]
    return [(k, t) for k, t in enumerate(out)] + [(6, out[6]), (6, out[6]), (None, out[10]), (None, None)]


def table(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([(k, t, "xx", "s", len(t or ""), 1, "s", 2, "k", 0.5) for k, t in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
