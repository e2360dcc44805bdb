"""Quality classifier: gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt, kernels
from .common import bounded_sample, held_out, one_text, pieces

#: Labelled rows that a model learns from, at most.
TRAIN_ROWS = 20_000
ACCEPT = 0.7


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of statistics for each text; an empty text has zeros."""
    s = kernels.text_stats(data, at) | kernels.class_counts(data, at)
    words, chars, lines = (np.maximum(s[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    shares = [s[k] / chars for k in ("n_upper", "n_digits", "n_bangs", "n_bars", "n_stops", "n_markup")]
    columns = [np.log1p(s["n_chars"]), np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_distinct_words"] / words, s["n_words"] / lines, s["n_bytes"] / chars, kernels.entropy(data, at), *shares]
    return np.stack(columns, 1)


def _train_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in pieces(batch.column("text")):
            x = features(data, at)
            rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows, batch.column("quality").slice(lo, hi - lo)], ["x", "quality"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> gbt.Trees:
    """Learn from at most `rows` labelled documents outside the held-out remainder; labels of null are no labels.

    Several labels of one document count as the least of them, and of several texts of one doc_id the one of least hash
    counts. The sample is the part with the least hash of doc_id, so its size is bounded and it can be broadcast.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = bounded_sample(known, "doc_id", rows)
    got = one_text(docs, sample, "quality").mapInArrow(_train_features, "x array<double>, quality int").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, 1))
    order = np.lexsort(np.column_stack([x, got["quality"].to_numpy()]).T) if len(got) else np.zeros(0, int)  # the same model whatever the partitions
    return gbt.fit(x[order], got["quality"].to_numpy(float)[order])


def _scorer(trees: gbt.Trees, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trees.score(features(data, at)) for _, _, data, at in pieces(batch.column("text"))]
            value = np.concatenate(found) if found else np.zeros(0)
            if keep:
                yield batch.filter(pa.array(value >= ACCEPT))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= ACCEPT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return score


def score(docs: DataFrame, trees: gbt.Trees) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, repeated rows and null ids included; a null text counts as empty."""
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(trees, False), "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, trees: gbt.Trees) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches ACCEPT."""
    return docs.mapInArrow(_scorer(trees, True), docs.schema)
