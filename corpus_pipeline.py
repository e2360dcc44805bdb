"""A training corpus from raw documents: five operators in a row, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm import decontam, jaccard, pieces, quality_model, suffixes
from bytelode.llm.common import delete, discard, read, scratch, stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: For each application the scratch tables that the result of the stage called last reads.
_left: dict[str, list[str]] = {}


def _owns_scratch(stage: Stage) -> Stage:
    """A stage's scratch tables go when the next stage is called: its result has been written and read back by then.

    One pipeline runs at a time in an application. Tables that docs itself still reads stay.
    """

    @wraps(stage)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if old := _left.pop(app, []):
            files = docs.inputFiles()
            delete(spark, [at for at in old if not any(at.rsplit("/", 1)[1] in f for f in files)])
        with scratch() as made:
            out = stage(spark, docs, sf_dir)
        _left[app] = made
        return out

    return called


@_owns_scratch
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_model.accepted(docs, quality_model.train(docs, read(spark, sf_dir, "labels")))


@_owns_scratch
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on shingles of five words."""
    return jaccard.representatives(docs, words=5, percent=80)


@_owns_scratch
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that also start elsewhere; n_chars follows the text."""
    return suffixes.dedup(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


@_owns_scratch
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage close to a benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


@_owns_scratch
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip."""
    return pieces.encode(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Trained trees, edit distances and tokenisation are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read back by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
