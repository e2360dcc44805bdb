"""Jaccard join, suffix-array dedup and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from bytelode.llm import jaccard, queries, suffixes
from bytelode.llm.components import components
from tests.duck import connect, same
from tests.llm.data import empty, sentence, table, texts

SF = "/root/testdata/sf0.001"


def shingle_set(text: str | None, k: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def linked(sets: list[set], percent: int) -> list[int]:
    """For each set the least index that it reaches."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(len(sets))]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_join(spark, words: int, percent: int) -> None:
    rows = [r for r in texts() if r[0] is not None]
    sets = [shingle_set(t, words) for _, t in rows]
    roots = linked(sets, percent)
    least: dict[int, int] = {}
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    wanted = sorted((rows[k][0], len(sets[k]), least[roots[k]]) for k in range(len(rows)))
    assert sorted(map(tuple, jaccard.join(table(spark, rows), words, percent).collect())) == wanted


def test_join_beside_rows_without_id(spark) -> None:
    draw, rows, wanted = random.Random(9), [], []
    for group in range(12):  # the text without id stands between two others: it shares every bucket that they share, and leads some
        base = sentence(draw, 120).split()
        near = [" ".join([*base[:k], "x" + base[k], *base[k + 1 :]]) for k in (30, 90)]
        assert len({*linked([shingle_set(t, 5) for t in near], 80)}) == 1
        rows += [(None, " ".join(base)), (2 * group, near[0]), (2 * group + 1, near[1])]
        wanted += [(2 * group, 2 * group), (2 * group + 1, 2 * group)]
    found = [(r.doc_id, r.component_id) for r in jaccard.join(table(spark, rows), 5, 80).collect()]
    assert sorted(x for x in found if x[0] is not None) == wanted and found.count((None, None)) == 12


def test_join_sql(spark) -> None:
    same(queries.QUERIES["op1_jaccard_join"](spark, SF), connect(SF).sql(queries.ORACLES["op1_jaccard_join"]).df())


def test_bands_bound_every_pair() -> None:
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for a in range(1, 400):
            for b in range(-(-a * percent // 100), a + 1):
                if a > bands.first:
                    k = next(i for i, hi in enumerate(bands.hi) if a <= hi)
                    assert bands.least[k] <= b and bands.difference(a + b) <= bands.may_differ[k] < bands.blocks[k]
                else:
                    assert bands.difference(a + b) == 0


def test_representatives_and_empty(spark) -> None:
    docs = table(spark, texts())
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 0 in ids and 1 in ids and ids.count(None) == 2
    assert jaccard.join(empty(spark)).count() == 0 and jaccard.representatives(empty(spark)).count() == 0


def test_components(spark) -> None:
    draw = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(draw.randrange(100, 200), draw.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def least(x: int) -> int:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: least(x) for x in near if least(x) != x}


def suffixes_by_hand(rows: list[tuple]) -> list[tuple]:
    data = [(t or "").encode() for _, t in rows]
    n = suffixes.LENGTH
    seen = Counter(d[k : k + n] for d in data for k in range(len(d) - n + 1))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - n + 1):
            if seen[d[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        left = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((doc, len(d), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_suffixes(spark, hot: int) -> None:
    rows = texts(2)
    assert sorted(map(tuple, suffixes.report(table(spark, rows), hot).collect()), key=str) == suffixes_by_hand(rows)


def test_suffix_dedup_keeps_columns(spark) -> None:
    rows = [(1, "ä" * 150 + "x" * 300), (2, "ö" + "ä" * 149 + "y" * 10), (3, "short"), (4, None)]
    out = suffixes.dedup(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[3] == "short" and left[4] is None and left[2] == "ö" + "y" * 10 and set(left[1]) <= {"ä", "x"}
    assert suffixes.report(empty(spark)).count() == 0


def test_representatives_of_repeated_ids(spark) -> None:
    draw = random.Random(5)
    one, other, third = (sentence(draw, 60) for _ in range(3))
    rows = [(0, one), (1, one), (1, other), (1, other), (2, third), (3, third.upper()), (4, None), (4, ""), (None, one)]
    kept = jaccard.representatives(table(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(0, one), (1, other), (2, third), (4, None), (4, ""), (None, one)], key=str)


def test_structured_words_stay_apart(spark) -> None:
    """Words that a polynomial hash modulo a power of two cannot tell apart: a sequence and its complement."""
    bits = [k.bit_count() % 2 for k in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    out = jaccard.join(table(spark, [(1, a), (2, b), (3, a)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 2), (3, 1)]


def test_spared_keys_leave_every_similar_pair_a_bucket() -> None:
    """Whatever the order of keys, two similar sets meet in one that neither spares."""
    import numpy as np

    bands, draw = jaccard.Bands(80), np.random.default_rng(3)
    for _ in range(200):
        base = draw.integers(1, 1 << 62, int(draw.integers(30, 200)), dtype=np.uint64)
        other = base.copy()
        other[: max(1, len(base) // 10)] += np.uint64(1)  # of 1.1 n elements 0.9 n are common
        value = np.concatenate([np.unique(base), np.unique(other)])
        owner = np.repeat([0, 1], [len(np.unique(base)), len(np.unique(other))])
        keys, at, of, band, spare = jaccard.blocks(owner, value, 2, bands)
        left = []
        for who in (0, 1):
            mine = keys[at[who] : at[who + 1]]
            keep: set[int] = set()
            for b, n in zip(band[of == who], spare[of == who], strict=True):
                keep |= set(sorted(mine[mine & 63 == b].tolist())[int(n) :])
            left.append(keep)
        assert left[0] & left[1]


def test_anchors_do_not_depend_on_their_piece() -> None:
    import numpy as np

    draw = np.random.default_rng(8)
    passage, before = draw.integers(97, 101, 400).astype(np.uint8), draw.integers(97, 101, 70_000).astype(np.uint8)
    alone = suffixes.anchors(passage, np.array([0, 400]))
    with_more = suffixes.anchors(np.concatenate([before, passage]), np.array([0, 70_000, 70_400]))
    mine = with_more["text"] == 1
    assert [alone[k].tolist() for k in ("place", "bucket", "kind", "low", "high")] == [with_more[k][mine].tolist() for k in ("place", "bucket", "kind", "low", "high")]
