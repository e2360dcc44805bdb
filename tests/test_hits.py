"""Benchmark items as search patterns: whole, of any length, in blocks."""

from __future__ import annotations

import pytest

from bytelode.plans import queries

ITEMS = [(1, "the same beginning, one end"), (2, "the same beginning, another end"), (3, "short"), (4, ""), (5, None), (6, "aa"), (6, "aa"), (7, "nowhere at all"), (8, "ünï cödé")]
TEXTS = ["the same beginning, one end. the same beginning, one end", "the same beginning, but no item", "short aaaaa ünï cödé", None, ""]


@pytest.mark.parametrize("chars", [queries.scan.PATTERN_CHARS, 10])
def test_whole_items(spark, chars: int) -> None:
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r.item_id: r.n_hits for r in queries._item_hits(docs, items, chars).collect()}
    assert found == {1: 2, 3: 1, 6: 4, 8: 1}


def test_no_items(spark) -> None:
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert queries._item_hits(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert queries._item_hits(docs, spark.createDataFrame([(1, "")], "item_id long, text string")).count() == 0


def test_item_hits_tell_items_apart(spark, tmp_path) -> None:
    for name, rows, schema in (("documents", list(enumerate(TEXTS)), "doc_id long, text string"), ("benchmark", ITEMS, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r.item_id: r.n_hits for r in queries.item_hits(spark, str(tmp_path)).collect()}
    assert found == {1: 2, 3: 1, 6: 4, 8: 1}
