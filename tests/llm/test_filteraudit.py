"""The filter audit against plain loops over all orders, its tries against dictionaries, and its SQL."""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from bytelode.llm import filteraudit, queries
from tests.duck import connect, same
from tests.llm.data import SCHEMA, empty, sentence

SF = "/root/testdata/sf0.01"
if not os.path.isdir(SF):
    SF = "/root/testdata/sf0.001"


def fails(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))
    return {f for f, t in zip("ABCD", tests, strict=True) if t}


def wanted(rows: list[tuple], labels: list[tuple]) -> Counter:
    """Filter by filter, as they would be applied."""
    out: Counter = Counter()
    failed = []
    for doc_id, text, part in rows:
        repeated = doc_id is not None and any(d is not None and d < doc_id and (t or "") == (text or "") for d, t, _ in rows)
        failed.append((fails(text or "") | ({"E"} if repeated else set()), part or "", any(d == doc_id and q == 1 for d, q, _ in labels), any(d == doc_id and x == 1 for d, _, x in labels)))
    for part in {f[1] for f in failed}:
        shapley: Counter = Counter()
        for order in permutations("ABCDE"):
            alive = [f for f in failed if f[1] == part]
            for k, f in enumerate(order):
                gone = [x for x in alive if f in x[0]]
                alive = [x for x in alive if f not in x[0]]
                every = [x for x in failed if x[1] == part and f in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = (len(alive), len(gone), len(every) - len(gone), sum(x[0] == {f} for x in every), sum(x[2] for x in gone), sum(x[3] for x in gone))
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1] += (shapley[f],)
    return out


def corpus() -> list[tuple]:
    draw = random.Random(5)
    texts = [sentence(draw, n) for n in (20, 150, 260, 300)] + ["a b " * 150, "A" + sentence(draw, 30), "x | " + sentence(draw, 220), "UP " * 300, "", None, " \n", "é漢 " * 210]
    rows = [(k, draw.choice(texts), draw.choice(["s", "t", None, ""])) for k in range(120)]
    hot = sentence(draw, 240)
    rows += [(1000 - k, hot, "s") for k in range(60)] + [(2000 + k, hot[: 40 * k], "u") for k in range(1, 20)]  # prefixes of one another
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(None, hot, "s"), (None, None, None), (-7, "", "t")]
    return rows


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(k, t, "xx", p, 1, 1, "s", 2, "k", 0.5) for k, t, p in rows], SCHEMA).repartition(5)


def test_audit(spark) -> None:
    rows, draw = corpus(), random.Random(6)
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in [*range(0, 120, 2), *range(950, 1001), 4, 4, None]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)
    expected = wanted(rows, labels)
    for most in (filteraudit.TRIE_BYTES, 3000, 0):
        found = filteraudit.audit(frame(spark, rows), table, most).collect()
        assert len(found) == len(expected) and {tuple(r[:3]): tuple(r[3:]) for r in found} == expected
    assert filteraudit.audit(empty(spark), table).collect() == []
    nothing = filteraudit.audit(frame(spark, rows), table.limit(0)).groupBy("part").sum("good_lost", "toxic_lost").collect()
    assert len(nothing) == 4 and all(r[1] == r[2] == 0 for r in nothing)


def test_prefixes(spark) -> None:
    """Copies that differ late are parted; texts of one range are few; equal texts share a range."""
    draw = random.Random(2)
    base = sentence(draw, 2000)
    near = [base[:8000] + sentence(draw, 20) for _ in range(400)]
    rows = [(k, t, "s") for k, t in enumerate(near + [sentence(draw, 30) for _ in range(100)] + [base] * 200)]
    bounds = filteraudit.prefixes(frame(spark, rows), 10)
    assert bounds == sorted(set(bounds)) and 5 <= len(bounds) < 10
    where = Counter(filteraudit.bisect_right(bounds, t.encode()) for t in near)
    assert max(where.values()) < 150
    assert filteraudit.prefixes(empty(spark), 10) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6).map(lambda t: (t * 9).encode()), st.one_of(st.none(), st.integers(0, 9)))))
def test_trie(given_rows: list[tuple[bytes, int | None]]) -> None:
    trie = filteraudit.Trie()
    for text, doc_id in given_rows:
        trie.insert(text, doc_id, "s", 0, 1)
    smallest = {t: min((d for x, d in given_rows if x == t and d is not None), default=None) for t, _ in given_rows}
    expected = Counter((t, d is not None and d > smallest[t], (d, "s", 0)) for t, d in given_rows)
    assert {(t, twice, row): n for t, twice, row, n in trie.traverse()} == expected


def test_masks() -> None:
    texts = ["", " ", "A b", "Ab " * 250, "w" * (3 << 20), "ab cd " * 400_000 + "x" * (2 << 20) + " y", "$", "é" * 30, "x\x0by\x1cz " * 100]
    raw = [t.encode() for t in texts]
    data, at = filteraudit.np.frombuffer(b"".join(raw), filteraudit.np.uint8), filteraudit.np.cumsum([0, *map(len, raw)])
    assert filteraudit.masks(data, at).tolist() == [sum(1 << "ABCD".index(f) for f in fails(t)) for t in texts]


def test_sql(spark) -> None:
    same(queries.op12_filter_interaction_audit(spark, SF), connect(SF).sql(queries.ORACLES["op12_filter_interaction_audit"]).df())
