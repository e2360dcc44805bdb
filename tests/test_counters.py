"""Headers of a catalog counted by an automaton: as often as `Signatures` finds places."""

from __future__ import annotations

from bytelode.operators.scan import Counters
from bytelode.operators.signatures import Signatures
from bytelode.operators.specs import Spec

WORDS = ["other ", "another ", "the ", "aa", "a", "the ", "\xfcn"]


def test_counts_are_those_of_places(monkeypatch) -> None:
    specs = [Spec("Config", w, w.encode(), None, 10) for w in WORDS]
    specs += [Spec("Config", "f", b"THE ", None, 10, False), Spec("Config", "w", b"t?e", None, 10), Spec("Config", "asc", b"e ", None, 10, search_type="Ascii"), Spec("Config", "r", b"er", None, 10, search_type="Reverse")]
    pieces = ["another the aaaa The ünother ".encode(), b"", b"th", b"e other", b" \xff\xfe\x00the "]
    wanted: dict[int, int] = {}
    for p in pieces:
        for k, at in Signatures(specs).places(p).items():
            wanted[10 * k] = wanted.get(10 * k, 0) + len(at)
    counters = Counters(specs, [10 * k for k in range(len(specs))])
    assert counters.count(pieces) == wanted
    # plain headers never go through a comparison for each header
    monkeypatch.setattr(Signatures, "find", None)
    assert Counters(specs[: len(WORDS)], range(len(WORDS))).count(pieces) == {k: wanted[10 * k] for k in range(len(WORDS)) if 10 * k in wanted}
