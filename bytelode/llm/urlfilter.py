"""URL filters: allow and block rules by host and path, and boosted trees on lexical features for the urls that no rule fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt, kernels
from .common import bounded_sample, pieces

#: verdict, then host and path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labelled urls that the trees learn from, at most, and hash buckets into which all suffixes fall.
TRAIN_ROWS, SUFFIXES = 20_000, 1 << 16
_HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, _HOST_PATH, 1), capitals, capitals.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HOST_PATH, 2), F.lit(""))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are configuration: a short list, tried longest first."""
    name = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        where, _, rest = text.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def lexical(data: np.ndarray, at: np.ndarray, suffix_share: np.ndarray) -> np.ndarray:
    """Length, depth, digits, entropy, parameters, host shape and the suffix's share, for each url."""
    size = np.maximum(np.diff(at), 1)
    of = lambda chars: kernels.counts(np.isin(data, np.frombuffer(chars, np.uint8)), at)
    digits, slash, dots = of(b"0123456789"), of(b"/"), of(b".")
    letters = kernels.counts(((data | 32) >= 97) & ((data | 32) <= 122), at)
    return np.stack([np.diff(at), slash, digits, digits / size, kernels.entropy(data, at), of(b"&") + of(b"?"), of(b"="), of(b"#"), dots, of(b"-_"), of(b"%"), letters / size, suffix_share], 1).astype(float)


def _suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


def _features(shares: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shares[np.asarray(batch.column("suffix"))]
            for lo, hi, data, at in pieces(batch.column("url")):
                x = lexical(data, at, known[lo:hi])
                rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([rows, batch.column("allow").slice(lo, hi - lo)], ["x", "allow"])

    return run


def _scorer(trees: gbt.Trees, shares: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shares[np.asarray(batch.column("suffix"))]
            found = [trees.score(lexical(data, at, known[lo:hi])) for lo, hi, data, at in pieces(batch.column("url"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("page_id", "host", "path", "rule", "ruled")), pa.array(np.concatenate(found) if found else np.zeros(0))], ["page_id", "host", "path", "rule", "ruled", "score"])

    return run


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' belief in allow) for each row of pages.

    The urls that a rule decides are the labelled ones: the trees learn on at most `rows` different ones, by least hash of
    the url, and judge the rest: allow from a score of 0.5 on. Null urls and urls without :// have an empty host and path and
    no rule. Repeated rows are judged alike. Without labelled urls the score is 0.5 and the verdict allow.
    """
    named = pages.select(F.col("page_id").cast("long"), "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    suffix = F.pmod(F.xxhash64(_suffix(F.col("host"))), F.lit(SUFFIXES)).cast("int")
    named = named.select("*", name.alias("rule"), verdict.alias("ruled"), suffix.alias("suffix"))
    labelled = named.where("ruled is not null").select("url", "suffix", (F.col("ruled") == "allow").cast("int").alias("allow"))
    n, allowed = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for at, rows_of, allowed_of in labelled.groupBy("suffix").agg(F.count("*"), F.sum("allow")).collect():
        n[at], allowed[at] = rows_of, allowed_of
    prior = (allowed.sum() + 1) / (n.sum() + 2)
    shares = (allowed + 10 * prior) / (n + 10)
    got = bounded_sample(labelled.dropDuplicates(["url"]), "url", rows).mapInArrow(_features(shares), "x array<double>, allow int").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, 1))
    order = np.lexsort(np.column_stack([x, got["allow"].to_numpy()]).T) if len(got) else np.zeros(0, int)
    trees = gbt.fit(x[order], got["allow"].to_numpy(float)[order], trees=60)
    out = named.mapInArrow(_scorer(trees, shares), "page_id long, host string, path string, rule string, ruled string, score double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")
