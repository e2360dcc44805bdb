"""Recovery scores the blocks of many small images at once, and images need not be dealt out again to be joined."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelode.functions import walkers as W
from bytelode.operators import recover as R
from bytelode.plans import queries as core

C = R.RecoveryConfig(64, 512, 3, 1.0, 0.0)


def entropy(block: bytes) -> float:
    n = np.unique(np.frombuffer(block, np.uint8), return_counts=True)[1] / len(block)
    return -(n * np.log2(n)).sum()


def test_blocks_of_many_images_are_scored_at_once(monkeypatch) -> None:
    rng, calls, plain = np.random.default_rng(5), [], R.block_entropy
    monkeypatch.setattr(R, "block_entropy", lambda *x: calls.append(1) or plain(*x))
    images = [bytes(rng.choice([0, 65, 255], 90)) * int(k % 9) + bytes(k % 70) for k in range(200)]
    asked = [(R.Held(x), {"image_id": str(k), "seq": seq, "at": at}) for k, x in enumerate(images) for seq, at in ((None, 0), (1, 70), (2, len(x) - 20), (3, len(x) - 5))]
    wanted = set()
    for k, x in enumerate(images):
        for at in range(0, max(len(x) - 64, 0), 64):
            if (e := entropy(x[at : at + 64])) >= 1.0:
                wanted.add((str(k), None, at, round(e, 9), W.ff_validity(x[at : at + 64])))
        wanted |= {(str(k), seq, at, None, W.ff_validity(x[at : at + 64])) for seq, at in ((1, 70), (2, len(x) - 20)) if at >= 0 and len(x) - at >= 16}
    found = [row for image, columns in R._scores(C)(iter(asked)) for row in zip(image.to_pylist(), *(c.to_pylist() for c in columns), strict=True)]
    assert {(i, seq, at, None if e is None else round(e, 9), ff) for i, seq, at, e, ff in found} == wanted and len(found) == len(wanted)
    assert len(calls) == 1


@pytest.mark.parametrize("size", [9, 64, 512])
def test_entropies_are_those_of_the_formula(size: int) -> None:
    data = bytes(np.random.default_rng(size).integers(0, 40, 3000).astype(np.uint8))
    starts = np.arange(0, len(data), size)
    assert np.allclose(R.block_entropy(data, starts, size), [entropy(data[k : k + size]) for k in starts], atol=1e-12)


def test_images_are_dealt_out_once_by_their_name(spark) -> None:
    plan = core.images(spark, "/root/testdata/sf0.001").groupBy("image_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_disks_are_made_where_their_images_are(spark) -> None:
    parts = core.images(spark, "/root/testdata/sf0.001", F.expr("o_orderkey div 100").alias("disk"), key="disk")
    assert parts.groupBy("disk").agg(F.collect_list("content"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
