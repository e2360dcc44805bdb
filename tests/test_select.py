"""Greedy selection of keys with many rows against a plain walk."""

from __future__ import annotations

import random

import pytest

from bytelode.operators import select


def walk(rows: list[tuple]) -> list[tuple]:
    out, end = [], {}
    for r in sorted(rows):
        if r[0] not in end or r[1] >= end[r[0]]:
            out.append(r)
            end[r[0]] = r[1] + r[2]
    return out


@pytest.mark.parametrize("longest", [1, 40, 10_000])
def test_greedy_any(spark, longest: int) -> None:
    draw = random.Random(4)
    rows = [(1, 3 * k, draw.choice([4, 9, 25]), k) for k in range(300)]  # one chain without a gap
    rows += [(2, draw.randrange(2000), draw.choice([0, 0, 1, 5, 30]), k) for k in range(300)] + [(3, 7, 0, k) for k in range(5)] + [(4, 1, 2, 0)]
    spark_rows = spark.createDataFrame(rows, "u long, pos long, len long, e long").repartition(3)
    found = select.greedy_any(spark_rows, ["u"], "pos", "len", longest)
    assert found.columns == spark_rows.columns
    assert sorted(map(tuple, found.collect())) == walk(rows)


def test_no_array_is_longer(spark, monkeypatch) -> None:
    seen = []
    gathered = select.greedy
    monkeypatch.setattr(select, "greedy", lambda df, keys, *a: (seen.append(max((r[0] for r in df.groupBy(*keys).count().select("count").collect()), default=0)), gathered(df, keys, *a))[1])
    rows = spark.createDataFrame([(1, k, 3, k) for k in range(200)] + [(2, 10 * k, 3, k) for k in range(200)], "u long, pos long, len long, e long")
    assert select.greedy_any(rows, ["u"], "pos", "len", 50).count() == 67 + 200
    assert max(seen) <= 50
