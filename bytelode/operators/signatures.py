"""Where the headers of a catalog stand in bytes: one pass over these, however long the catalog is.

Every header has an anchor, two successive bytes of it that few other headers have. A table of all 65,536 pairs of bytes
marks the anchors; places whose pair is marked are then compared with the headers of that anchor, byte after byte, for
all places at once. A ? fits any byte, and letters of specs that fold case fit both cases: such anchors have several pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

from bytelode.functions.bytesx import WILDCARD

from .specs import Spec

#: Bytes that are looked at together.
STEP = 1 << 20
#: Bytes that fill empty space; an anchor without them is met less often.
_COMMON = {0x00, 0x20, 0xFF}


def printable(byte: int) -> bool:
    return 32 <= byte < 127 or byte in (9, 10, 13)


_PRINTABLE = np.array([printable(b) for b in range(256)])


def _fits(byte: int, case_sensitive: bool) -> list[int]:
    """The bytes that a byte of a header stands for."""
    if byte == WILDCARD:
        return list(range(256))
    letter = bytes([byte])
    return [byte] if case_sensitive or not letter.isalpha() else sorted({*letter.lower(), *letter.upper()})


class Signatures:
    def __init__(self, specs: list[Spec]) -> None:
        self.specs = specs
        self.table = np.zeros(1 << 16, bool)
        self.anchored: dict[int, list[tuple[int, int]]] = {}
        self.tests: list[list[tuple[int, int | np.ndarray]]] = []
        for idx, spec in enumerate(specs):
            fits = [_fits(b, spec.case_sensitive) for b in spec.header]
            at, pairs = self._anchor(fits)
            for p in pairs:
                self.table[p] = True
                self.anchored.setdefault(p, []).append((idx, at))
            self.tests.append([(k, f[0] if len(f) == 1 else _among(f)) for k, f in enumerate(fits) if len(f) < 256 and k not in (at, at + 1)])

    def _anchor(self, fits: list[list[int]]) -> tuple[int, list[int]]:
        """The place in a header of its anchor, and the anchor's pairs: as few as may be, rare ones, and those that the fewest other headers have."""
        fits = fits + [list(range(256))] * (len(fits) == 1)
        few = min(len(a) * len(b) for a, b in zip(fits, fits[1:], strict=False))
        options = []
        for k, (a, b) in enumerate(zip(fits, fits[1:], strict=False)):
            if len(a) * len(b) == few:
                pairs = [x << 8 | y for x, y in product(a, b)]
                options.append((len(_COMMON & {a[0], b[0]}), sum(len(self.anchored.get(p, ())) for p in pairs[:4]), k, pairs))
        return min(options)[2:]

    def find(self, data: bytes) -> dict[int, np.ndarray]:
        """For each spec that is met the places of its header, ascending, overlapping ones too."""
        values = np.frombuffer(data, np.uint8)
        found: dict[int, list[np.ndarray]] = {}
        for lo in range(0, len(values), STEP):
            part = values[lo : lo + STEP + 1]
            if lo + STEP >= len(values):
                part = np.append(part, np.uint8(0))
            pair = part[:-1].astype(np.uint16) << np.uint16(8) | part[1:]
            at = np.flatnonzero(self.table[pair])
            if not len(at):
                continue
            of = pair[at]
            order = np.argsort(of, kind="stable")
            of, at = of[order], at[order] + lo
            cuts = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                for idx, k in self.anchored[int(of[a])]:
                    start = self._verified(values, at[a:b] - k, idx)
                    if len(start):
                        found.setdefault(idx, []).append(start)
        return {idx: np.sort(np.concatenate(parts)) for idx, parts in sorted(found.items())}

    def _verified(self, values: np.ndarray, start: np.ndarray, idx: int) -> np.ndarray:
        start = start[(start >= 0) & (start + len(self.specs[idx].header) <= len(values))]
        for k, wanted in self.tests[idx]:
            if not len(start):
                break
            here = values[start + k]
            start = start[here == wanted if isinstance(wanted, int) else wanted[here]]
        return start

    def places(self, data: bytes, quick_block: int = 0) -> dict[int, np.ndarray]:
        """As `find`: only at block boundaries in quick mode; else for Ascii only where all of the header's bytes are printable."""
        found = self.find(data)
        if quick_block:
            found = {idx: at[at % quick_block == 0] for idx, at in found.items()}
        else:
            values = np.frombuffer(data, np.uint8)
            for idx in [k for k in found if self.specs[k].search_type == "Ascii"]:
                found[idx] = found[idx][_PRINTABLE[values[found[idx][:, None] + np.arange(len(self.specs[idx].header))]].all(1)]
        return {idx: at for idx, at in found.items() if len(at)}

    def places_of(self, pieces: list[bytes], quick_block: int = 0) -> list[dict[int, list[int]]]:
        """`places` of each piece, all of them looked through at once: many small ones take the steps of one."""
        if len(pieces) == 1:
            return [{idx: at.tolist() for idx, at in self.places(pieces[0], quick_block).items()}]
        data = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        out: list[dict[int, list[int]]] = [{} for _ in pieces]
        for idx, at in (self.find(data) if quick_block else self.places(data)).items():
            of = np.searchsorted(starts, at, "right") - 1
            here = at - starts[of]
            fits = at + len(self.specs[idx].header) <= ends[of]
            if quick_block:
                fits &= here % quick_block == 0
            of, here = of[fits], here[fits].tolist()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for owner, a, b in zip(of[cuts[:-1]].tolist() if len(of) else (), cuts, cuts[1:], strict=False):
                out[owner][idx] = here[a:b]
        return out


def together(pieces: Iterator[tuple[bytes, tuple]]) -> Iterator[list[tuple[bytes, tuple]]]:
    """Pieces, each with what belongs to it, in groups of some STEP bytes."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _among(fits: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[fits] = True
    return out
