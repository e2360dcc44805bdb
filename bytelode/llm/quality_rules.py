"""Quality rules whose cutoffs are chosen under a proven bound on how many good documents they reject.

Each rule compares one ratio of a document with a cutoff. All rules tighten along one fixed path: each goes from off to its
strictest cutoff, all at one pace. For every stratum (a band of word counts) and every step of the path all
documents labelled good that any rule would reject there are counted. Step by step an exact binomial test must reject that
the rules together falsely reject more than the allowed rate; the last step before the first failure holds, and without
one all rules are off in that stratum. Any step before it passed, too, so a less strict one may be taken. Testing in a fixed order needs no correction among the steps, and the rules are
tested together; so the level is divided by the number of strata only (Bonferroni), and some 90 good documents are enough
to get a stratum going.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import pieces, stash

#: Of the good documents of a stratum, all rules together reject no more than this share, with this probability of a mistake anywhere.
FALSE_REJECTIONS, MISTAKE = 0.05, 0.05
#: Of the steps that pass, none is taken that is seen to reject more than this share of the good documents counted.
SEEN = 0.005
STRATA = (100, 300, 1000, 3000)
#: Ratio and candidate cutoffs; a document with more is rejected.
_STEPS = [0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", _STEPS),
    "duplicate_lines": ("n_dup_lines / n_lines", _STEPS),
    "repeated_words": ("n_repeat_words / n_words", _STEPS),
    "capitals": ("n_upper / word_chars", _STEPS),
    "exclamations": ("n_bangs / n_words", _STEPS),
    "long_words": ("word_chars / n_words", [8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    "short_words": ("n_words / word_chars", [0.25, 0.3, 0.4, 0.5]),
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in pieces(batch.column("text")):
            s = kernels.text_stats(data, at) | kernels.class_counts(data, at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(s[k].astype(np.int64)) for k in _COUNTS)], ["doc_id", *_COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """The counts that the rules use, for each row of docs; a null text has no words."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} long" for k in _COUNTS))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for k, most in reversed(list(enumerate(STRATA))):
        out = F.when(F.col("n_words") < most, k).otherwise(out)
    return out


def ratio(rule: str) -> Column:
    return F.expr("double({}) / greatest({}, 1)".format(*RULES[rule][0].split(" / ")))


def below(n: int, k: int, p: float) -> float:
    """The probability that at most k of n independent trials of probability p succeed.

    Terms are summed from the largest that matters downwards until they vanish: some multiple of the square root of n of them.
    """
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total, i = 0.0, min(k, int(n * p + 40 * math.sqrt(n * p * (1 - p)) + 40))
    while i >= 0 and ((term := math.exp(log(i))) > total * 1e-17 or i > n * p):
        total, i = total + term, i - 1
    return min(1.0, total)


def path() -> list[tuple[str, float]]:
    """The rule that each step tightens, and its cutoff from there on. Rules keep pace: each is as far on its own way as the others."""
    steps = [((notch + 1) / len(cuts), k, rule, cut) for k, (rule, (_, cuts)) in enumerate(RULES.items()) for notch, cut in enumerate(reversed(cuts))]
    return [(rule, cut) for _, _, rule, cut in sorted(steps)]


def cutoffs_at(steps: int) -> dict[str, float]:
    """Each rule's cutoff after so many steps; a rule that is still off has none."""
    return dict(path()[:steps])


def rejected_at() -> Column:
    """The step from which on a document is rejected; as many as there are steps, if it never is."""
    steps, none = path(), len(path())
    first = []
    for rule, (_, cuts) in RULES.items():
        exceeded = sum((F.when(ratio(rule) > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
        at = [none, *(steps.index((rule, cut)) for cut in cuts)]  # the strictest cutoff that it exceeds comes last
        first.append(F.get(F.array(*map(F.lit, at)), exceeded))
    return F.least(*first)


def choose(good: dict[int, dict[int, int]], allowed: float = FALSE_REJECTIONS, mistake: float = MISTAKE) -> dict[int, int]:
    """How many steps each stratum may go, from counts of good documents by the step that first rejects them."""
    level, out = mistake / (len(STRATA) + 1), {}
    for band, by in good.items():
        n, over, steps = sum(by.values()), 0, 0
        for k in range(len(path())):
            over += by.get(k, 0)
            if below(n, over, allowed) > level:
                break
            steps = k + 1 if over <= SEEN * n else steps
        out[band] = steps
    return out


def limits(stats: DataFrame, labels: DataFrame) -> dict[int, int]:
    """Steps of each stratum from counts over all labelled documents that pass the base test; only the counts (strata x steps) reach the driver."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    known = stats.where(~base_failed()).join(good, "doc_id").groupBy(stratum().alias("band"), rejected_at().alias("step")).count()
    by: dict[int, dict[int, int]] = {}
    for band, step, n in known.collect():
        by.setdefault(band, {})[step] = n
    return choose(by)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of docs.

    Null and empty texts have no words and fail the base test; repeated rows and null ids are judged like others; with no
    labels no stratum takes a step, and only the base test rejects.
    """
    stats = stash(measure(docs), "rules")
    steps = limits(stats, labels)
    may = F.get(F.array(*(F.lit(steps.get(band, 0)) for band in range(len(STRATA) + 1))), stratum())
    return stats.select("doc_id", *_COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & (rejected_at() >= may)).alias("kept"))
