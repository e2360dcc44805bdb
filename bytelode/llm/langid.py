"""Language identification by error-correcting output codes.

Every language has a binary codeword; for every bit one linear classifier on hashed byte n-grams predicts it. Decoding
takes the codeword of least total logistic loss, so bits far from their boundary weigh more, and says when a second
codeword comes close.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import held_out, one_text, pieces

#: Documents that the classifiers learn from, about (every language has its share, and LEAST at least), and hashed n-gram features.
TRAIN_ROWS, LEAST, WIDTH = 4_000, 40, 2_048
#: Languages that are learned, at most: the most frequent ones.
LANGUAGES = 500
#: Bits of a codeword, and further ones for each doubling of the number of languages beyond 16.
BITS, MORE_BITS = 24, 8
UNKNOWN = "und"
#: Decisions whose best score is below this are flagged as ambiguous.
CLEAR = 0.8


def ngrams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of hashed bigram and trigram frequencies of each whole text, of unit length; case of A-Z is ignored."""
    n = len(at) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    low = kernels.LOWER[data].astype(np.uint32)
    low[kernels.SEPARATOR[data] | ((data >= 48) & (data < 58))] = 32
    two = np.zeros(len(low), np.uint32)
    two[:-1] = low[:-1] << np.uint32(8) | low[1:]
    three = np.zeros(len(low), np.uint32)
    three[:-2] = two[:-2] << np.uint32(8) | low[2:]
    owner = np.repeat(np.arange(n) * WIDTH, np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(low))
    for grams, reach in ((two, 2), (three, 3)):
        ok = left >= reach
        place = ((grams * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64) + owner
        out += np.bincount(place[ok], minlength=n * WIDTH).reshape(n, WIDTH)
    np.sqrt(out, out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def bits_for(classes: int) -> int:
    return BITS + MORE_BITS * max(0, (classes - 1).bit_length() - 4)


def codebook(classes: int, bits: int | None = None) -> np.ndarray:
    """Codewords of +1 and -1, from seeded candidates the one farthest from those taken, each bit splitting the classes."""
    bits = bits or bits_for(classes)
    draw = np.random.default_rng(7)
    words = np.where(np.arange(bits) % 2, 1, -1)[None]
    while len(words) < classes:
        candidates = draw.choice([-1, 1], (512, bits))
        distance = np.min((bits - candidates @ words.T) / 2, 1)
        words = np.vstack([words, candidates[np.argmax(distance)]])
    return words.astype(np.float64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    weight: np.ndarray  # (WIDTH, bits)
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its share of the likelihood over all codewords."""
        f = x @ self.weight + self.bias
        loss = np.logaddexp(0, -f) @ (self.code.T > 0) + np.logaddexp(0, f) @ (self.code.T < 0)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        return np.argmin(loss, 1), 1 / odds.sum(1)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, rate: float = 0.05) -> Model:
    """All bits at once: logistic loss, Adam over the whole sample."""
    code = codebook(len(languages))
    bits = code.shape[1]
    w, b = np.zeros((WIDTH, bits), np.float32), np.zeros(bits, np.float32)
    if len(y):
        target = ((code[y] + 1) / 2).astype(np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            error = 1 / (1 + np.exp(-(x @ w + b))) - target
            g = x.T @ error / len(y) + 1e-6 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * 10 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * 0.1
            b -= rate * error.mean(0)
    return Model(languages, code, w * np.float32(4), b * np.float32(4))


def _train_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in pieces(batch.column("text")):
            x = ngrams(data, at).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], DataFrame]:
    """The languages to learn, and doc_id and lang of the documents to learn from, outside the held-out remainder.

    Of each of the LANGUAGES most frequent languages these are the rows / languages documents, LEAST or more, with the least
    hash of doc_id: at most the larger of rows and LEAST * LANGUAGES. A doc_id with several langs counts as the least of them.
    """
    spark = docs.sparkSession
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    most = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in most)
    each = max(rows // max(len(languages), 1), LEAST)
    # The least hashes of a language lie below a bound that its count tells: only about `each` rows of it are ever ordered.
    enough = each + 8 * math.sqrt(each) + 8
    below = spark.createDataFrame([(r["lang"], min(2**63 - 1, int(enough / r["n"] * 2**64) - 2**63)) for r in most], "lang string, bound long")
    few = ids.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(below), "lang").where(F.col("h") <= F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return languages, few.withColumn("k", rank).where(F.col("k") <= each).select("doc_id", "lang")


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn every language of `sample` from its texts. Null texts and langs teach nothing."""
    languages, chosen = sample(docs, rows)
    got = one_text(docs.where("text is not null").select("doc_id", "text"), chosen, "lang").mapInArrow(_train_features, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, WIDTH).astype(np.float32)
    place = {name: k for k, name in enumerate(languages)}
    return fit(x, got["lang"].map(place).to_numpy(np.int64), languages or [UNKNOWN])


def _has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts with an ASCII letter, or else any Unicode letter."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    out = kernels.counts(ascii_letter, at) > 0
    for k in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[k] = any(c.isalpha() for c in data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _predictor(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [np.zeros(0, object)], [np.zeros(0)]
            for _, _, data, at in pieces(batch.column("text"), 1 << 18):
                best, share = model.decode(ngrams(data, at))
                letter = _has_letter(data, at)
                lang.append(names[np.where(letter, best, len(names) - 1)])
                score.append(np.where(letter, share, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(lang), pa.string()), pa.array(np.concatenate(score))], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for each row of docs, repeated rows and null ids included.

    A null text, an empty one or one without any letter is `und` with score 0 (ambiguous).
    """
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", (F.col("score") < CLEAR).alias("ambiguous"))
