"""SentencePiece encoding and decoding in batched numpy.

All distinct words of equal length advance together, character by character. For every end position the substrings that
end there are looked up by hash among the sorted keys of the pieces, and the best admissible one is kept as a
backpointer, as in Viterbi's algorithm. Scores add up for unigram models. A BPE model's scores are merge priorities,
whose sums say nothing; there a piece is admissible after the last piece of the best path before it only if merging the
two together would leave just this pair, which makes the path the one that merging finds (checked against the library).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are segmented at once, and distinct words and pairs that a worker remembers, at most.
PIECE, REMEMBERED = 1 << 21, 1 << 19
#: Pairs that a worker remembers at most, and pieces' hashes that are told apart at once, as powers of two.
SLOTS = 20
#: Fewer words of one length than this advance one by one.
FEW = 4
_STEP = 0x2545F4914F6CDD1D
_UP = np.full(1 << 10, _STEP, np.uint64)
_UP[0] = 1
_UP = np.multiply.accumulate(_UP)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Running hashes of the rows of a (words, length) array of code points: column i has that of the first i."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    value = (codes.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(32)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * np.uint64(_STEP) + value[:, i]
    return out


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    byte_ids: list[int]
    control: list[int]
    bpe: bool
    halves: np.ndarray | None = None  # of each piece the two that merge into it last, -1 where merging never makes it
    place: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        skip = {*self.byte_ids, *self.control}
        self.place = {p: k for k, p in enumerate(self.pieces) if k not in skip and p}
        if self.halves is None:
            self.halves = np.array([self._last_merge(p) if self.bpe and len(p) > 1 and k not in skip else (-1, -1) for k, p in enumerate(self.pieces)])
        self.left, self.right = self.halves.T.tolist()
        # when a merge is done: the pieces' order by score; single characters are there from the start
        order = np.empty(len(self.pieces), np.int64)
        order[np.lexsort((np.arange(len(self.pieces)), -self.scores))] = np.arange(len(self.pieces))
        self.when = np.where([len(p) == 1 for p in self.pieces], -1, order).tolist()
        self.rank = order.tolist()
        self.longest = max(map(len, self.place))
        by_length: dict[int, list[tuple[str, int]]] = {}
        for p, k in self.place.items():
            if self.bpe and len(p) > 1 and self.left[k] < 0:
                continue
            by_length.setdefault(len(p), []).append((p, k))
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, found in by_length.items():
            letters = np.array([[*map(ord, p)] for p, _ in found])
            h = _hash(letters)[:, -1]
            order = np.argsort(h)
            maybe = np.zeros(1 << SLOTS, bool)
            maybe[h >> np.uint64(64 - SLOTS)] = True
            self.keys[n] = h[order], np.array([k for _, k in found])[order], letters[order], maybe
        raw = [b"" if k in self.control else bytes([self.byte_ids.index(k)]) if k in skip else p.replace("\u2581", " ").encode() for k, p in enumerate(self.pieces)]
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.pairs: dict[int, bool] = {}
        self.met, self.met_ok = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_at, self.known_n, self.known_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _last_merge(self, piece: str) -> tuple[int, int]:
        made: list[tuple[str, str]] = []
        return tuple(self.place[x] for x in made[-1]) if self.merge([*piece], made) == [piece] and made and all(x in self.place for x in made[-1]) else (-1, -1)

    def merge(self, symbols: list[str], made: list[tuple[str, str]] | None = None) -> list[str]:
        """BPE: of the adjacent pairs that form a piece, the one of best score, then the leftmost, merges first; made gets all merges."""
        after, before, alive = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)], list(symbols)
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (k := self.place.get(both := alive[i] + alive[after[i]])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, after[i], both))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if after[i] != j or alive[i] + alive[j] != both or not alive[i]:
                continue
            if made is not None:
                made.append((alive[i], alive[j]))
            alive[i], alive[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -2
            offer(before[i])
            offer(i)
        return [s for s in alive if s]

    def fits(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging leaves just the two pieces apart; -1 is the start of a word, ids past the pieces are unknown characters."""
        n = len(self.pieces)
        free = (last < 0) | (last >= n) | (piece >= n)
        out = np.ones(len(last), bool)
        code = last[~free].astype(np.int64) * n + piece[~free]
        slot = (code.astype(np.uint64) * np.uint64(_STEP) >> np.uint64(64 - SLOTS)).astype(np.int64)
        got, new = self.met_ok[slot], np.flatnonzero(self.met[slot] != code)
        if len(new):
            unique, where = np.unique(code[new], return_inverse=True)
            found = np.array([self._stay_apart(*divmod(c, n)) for c in unique.tolist()], bool)
            got[new] = found[where]
            self.met[slot[new]], self.met_ok[slot[new]] = code[new], got[new]
        out[~free] = got
        return out

    def fit(self, last: int, piece: int) -> bool:
        """`fits` for one pair.

        The merges that made the two are undone one by one, the latest first. Whatever stands at the boundary then must not
        merge across it before the merge that was just undone: earlier in score or, of equal ones, further to the left.
        """
        n = len(self.pieces)
        if last < 0 or last >= n or piece >= n:
            return True
        ok = self.pairs.get(last * n + piece)
        if ok is None:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            ok = self.pairs[last * n + piece] = self._stay_apart(last, piece)
        return ok

    def _stay_apart(self, a: int, b: int) -> bool:
        pieces, place, rank, when, left, right = self.pieces, self.place, self.rank, self.when, self.left, self.right
        before = len(pieces)
        while True:
            both = place.get(pieces[a] + pieces[b])
            if both is not None and rank[both] < before:
                return False
            if when[a] > when[b]:
                before, a = when[a], right[a]
            elif when[b] >= 0:
                before, b = when[b] + 1, left[b]
            else:
                return True

    def segment(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length, as rows of code points: the ids of their pieces one after the other, and how many each has.

        An unknown character has id len(pieces) + its code point.
        """
        m, length = codes.shape
        sums, n = _hash(codes), len(self.pieces)
        last, back = np.full((m, length + 1), -1, np.int64), np.zeros((m, length + 1), np.int64)
        total = np.zeros((m, length + 1))
        lowest = float(self.scores.min()) - 10
        for i in range(1, length + 1):
            spans = range(max(0, i - self.longest), i)
            ids = np.full((m, len(spans)), -1, np.int64)
            for c, j in enumerate(spans):
                if i - j in self.keys:
                    keys, of, letters, maybe = self.keys[i - j]
                    h = sums[:, i] - sums[:, j] * _UP[i - j]
                    row = np.flatnonzero(maybe[h >> np.uint64(64 - SLOTS)])
                    at = np.minimum(np.searchsorted(keys, h[row]), len(keys) - 1)
                    same = keys[at] == h[row]
                    row, at = row[same], at[same]
                    same = (letters[at] == codes[row, j:i]).all(1)  # equal hashes are not yet equal characters
                    ids[row[same], c] = of[at[same]]
            alone = ids[:, -1] < 0
            ids[alone, -1] = n + codes[alone, i - 1]
            row, col = np.nonzero(ids >= 0)
            piece, start = ids[row, col], col + spans[0]
            score = np.where(piece < n, self.scores[np.minimum(piece, n - 1)], lowest)
            worth = np.full(ids.shape, -np.inf)
            if self.bpe:
                worth[row, col] = np.where(self.fits(last[row, start], piece), i - start, -np.inf)
            else:
                worth[row, col] = total[row, start] + score
            best = np.argmax(worth, 1)
            everyone = np.arange(m)
            back[:, i], last[:, i], total[:, i] = best + spans[0], ids[everyone, best], worth[everyone, best]
        out, position, counted = [], np.full(m, length), np.zeros(m, np.int64)
        while (left := np.flatnonzero(position > 0)).size:
            out.append((left, counted[left], last[left, position[left]]))
            counted[left] += 1
            position[left] = back[left, position[left]]
        ids = np.zeros(int(counted.sum()), np.int64)
        ends = np.cumsum(counted)
        for rows, k, piece in out:
            ids[ends[rows] - 1 - k] = piece
        return ids, counted

    def _bytes_for_unknown(self, ids: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the pieces of their UTF-8 bytes, or <unk> (id 0) in a model without them."""
        n, unknown = len(self.pieces), ids >= len(self.pieces)
        if not unknown.any():
            return ids, counted
        parts = [[self.byte_ids[b] for b in chr(c - n).encode("utf-8", "replace")] if self.byte_ids else [0] for c in ids[unknown].tolist()]
        wide = np.ones(len(ids), np.int64)
        wide[unknown] = [len(p) for p in parts]
        out = np.repeat(ids, wide)
        out[np.repeat(unknown, wide)] = [b for p in parts for b in p]
        owner = np.repeat(np.arange(len(counted)), counted)
        return out, np.bincount(owner, wide, len(counted)).astype(np.int64)

    def advance(self, word: str) -> list[int]:
        """The same search for one word alone: cheaper than arrays of one row where no other word has its length."""
        n, bpe = len(self.pieces), self.bpe
        lowest = float(self.scores.min()) - 10
        last, back, total = [-1], [0], [0.0]
        for i in range(1, len(word) + 1):
            best, start, piece = -np.inf, i - 1, n + ord(word[i - 1])
            for j in range(max(0, i - self.longest), i):
                k = self.place.get(word[j:i])
                if k is not None and bpe and i - j > 1 and self.left[k] < 0:
                    continue
                if k is None:
                    if j < i - 1:
                        continue
                    k = n + ord(word[j])
                if bpe:
                    if self.fit(last[j], k):
                        best, start, piece = 0.0, j, k
                        break
                elif (worth := total[j] + (float(self.scores[k]) if k < n else lowest)) > best:
                    best, start, piece = worth, j, k
            last.append(piece)
            back.append(start)
            total.append(best)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def learn(self, words: list[str]) -> None:
        """Segment the given new words, those of one length together, and remember their ids."""
        found: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        by_length: dict[int, list[str]] = {}
        for word in words:
            if self.bpe and word.startswith(MARK * 2):  # the pieces of runs of spaces tie in score: these merge one by one
                ids = np.array([self.place.get(s, len(self.pieces) + ord(s[0])) for s in self.merge([*word])])
                found.append(([word], *self._bytes_for_unknown(ids, np.array([len(ids)]))))
            else:
                by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            if len(group) < FEW:
                for word in group:
                    ids = np.array(self.advance(word))
                    found.append(([word], *self._bytes_for_unknown(ids, np.array([len(ids)]))))
                continue
            codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(group), length)
            found.append((group, *self._bytes_for_unknown(*self.segment(codes))))
        n = np.concatenate([self.known_n, *(f[2] for f in found)])
        self.known_at = np.cumsum(n) - n
        self.known_n = n
        for group, _, _ in found:
            self.known.update(zip(group, range(len(self.known), len(self.known) + len(group)), strict=True))
        self.known_ids = np.concatenate([self.known_ids, *(f[1].astype(np.int32) for f in found)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets; an empty text has no ids.

        Words that were met before are known by their characters, so an answer never depends on what else was encoded.
        """
        words: list[str] = []
        first = [0]
        for t in texts:
            if t:
                words += _WORD.findall(MARK + t.replace(" ", MARK))
            first.append(len(words))
        if not words:
            return np.zeros(0, np.int32), np.array(first)
        if len(self.known) > REMEMBERED:
            self.forget()
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = self.known_n[place]
        ends = np.cumsum(n)
        ids = self.known_ids[np.repeat(self.known_at[place] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[first]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts from ids and their offsets: pieces joined, marks turned to spaces, without the one space put before."""
        lo = self.raw_at[ids]
        n = self.raw_at[ids + 1] - lo
        ends = np.concatenate([[0], np.cumsum(n)])
        data = self.raw[np.repeat(lo - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cut = ends[at]
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@lru_cache(4)
def load(path: str = MODEL) -> Model:
    """Read a model's pieces with the public library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = proto.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    ids = list(range(library.get_piece_size()))
    byte_ids = [k for k in ids if library.is_byte(k)]
    control = [k for k in ids if library.is_control(k) or library.is_unknown(k)]
    return Model(library.id_to_piece(ids), np.array(library.get_score(ids)), byte_ids, control, spec.trainer_spec.model_type == spec.trainer_spec.BPE)


_worker: dict[tuple, Model] = {}


def _coder(parts: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (tuple(parts[0]), parts[1].tobytes(), tuple(parts[2]), tuple(parts[3]), parts[4], parts[5].tobytes())
        model = _worker.get(name) or _worker.setdefault(name, Model(*parts))
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + PIECE, "right")) - 1)
                ids, at = model.encode(texts[lo:hi])
                same = [a == b for a, b in zip(model.decode(ids, at), texts[lo:hi], strict=True)]
                rows = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), rows, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])
                lo = hi

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (decoding gives the text back) for each row of docs.

    A null or empty text has no ids. Repeated rows and null ids are encoded alike. A text that holds the mark U+2581 or
    lone surrogates comes back with spaces or replacement characters, and round_trip says so. The model is read where
    the driver runs; its pieces (about a megabyte) travel with the tasks.
    """
    model = load(path)
    parts = (model.pieces, model.scores, model.byte_ids, model.control, model.bpe, model.halves)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_coder(parts), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def _decoder(parts: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*parts)
        for batch in batches:
            rows = batch.column("ids").fill_null([])
            at = np.asarray(rows.offsets).astype(np.int64)
            texts = model.decode(np.asarray(rows.values.fill_null(0))[at[0] : at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text from ids; null ids count as none, and control pieces stand for nothing."""
    model = load(path)
    parts = (model.pieces, model.scores, model.byte_ids, model.control, model.bpe, model.halves)
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(_decoder(parts), "doc_id long, text string")

