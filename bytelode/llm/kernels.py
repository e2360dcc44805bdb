"""Vectorised numpy kernels over the bytes of many texts at once: words, hashes, lines and windows."""

from __future__ import annotations

import hashlib

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Byte ranges up to this long are hashed in lanes of 8 bytes, longer ones by BLAKE2b.
LANED = 512
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, as one integer; zeros follow the end. A view, not a copy of each."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges start..end, equal for equal bytes wherever they stand.

    Every lane passes through `mix`, which is not linear, so that no regular structure of the bytes makes hashes agree.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * _ODD + np.uint64(1))
    at = lanes(data)
    alive = np.flatnonzero((size > 0) & (size <= LANED))
    k = 0
    while len(alive):
        lane = at[start[alive] + k] & _LOW[np.minimum(size[alive] - k, 8)]
        out[alive] = mix((out[alive] ^ mix(lane + np.uint64(k))) * _ODD + np.uint64(1))
        k += 8
        alive = alive[size[alive] > k]
    for j in np.flatnonzero(size > LANED):
        out[j] = int.from_bytes(hashlib.blake2b(data[start[j] : end[j]].tobytes(), digest_size=8).digest(), "little")
    return out


def counts(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often mask holds within each of the ranges at[i]..at[i+1]."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, none across texts, and the place of each text's first word (n + 1)."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words and the index of their first word, for windows that stay within a text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix(out * _ODD + hashes[k : k + m] + np.uint64(k + 1))
    left = np.repeat(first[1:], np.diff(first))[:m] - np.arange(m)
    ok = np.flatnonzero(left >= n)
    return out[ok], ok


def owners(first: np.ndarray) -> np.ndarray:
    """For each item, the text that it is in; first as from `words`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def times_seen(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each item's value occurs within its own text."""
    if not len(value):
        return np.zeros(0, np.int64)
    order = np.lexsort((value, owner))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, in order."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]


def text_stats(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each text: words, code points, symbols, repeated lines, words in repeated 3-word windows and so on."""
    n = len(at) - 1
    start, end, first = words(data, at)
    hashes = spans(data, start, end)
    owner = owners(first)
    out = {"n_words": np.diff(first), "n_bytes": np.diff(at)}
    lead = (data & 0xC0) != 0x80
    inside = ~SEPARATOR[data]
    out["n_chars"] = counts(lead, at)
    out["word_chars"] = counts(lead & inside, at)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    out["n_symbols"] = counts(symbol[data], at)

    # Lines: cut after every \n and at the ends of texts.
    cut = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([at, cut + 1]))
    edges = edges[edges <= len(data)]
    lo, hi = edges[:-1], edges[1:]
    hi = hi - ((hi > lo) & (data[np.maximum(hi, 1) - 1] == 10)) if len(hi) else hi
    has_word = np.diff(np.searchsorted(start, edges)) > 0
    lo, hi = lo[has_word], hi[has_word]
    line_owner = np.searchsorted(at, lo, "right") - 1
    seen, _ = distinct(line_owner, spans(data, lo, hi)) if len(lo) else (np.zeros(0, np.int64), None)
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(seen, minlength=n)

    grams, where = windows(hashes, first, 3)
    again = where[times_seen(owner[where], grams) > 1]
    marks = np.zeros(len(start) + 1, bool)
    for k in range(3):
        marks[again + k] = True
    out["n_repeat_words"] = counts(marks[:-1], first) if len(start) else np.zeros(n, np.int64)
    seen, _ = distinct(owner, hashes) if len(hashes) else (np.zeros(0, np.int64), None)
    out["n_distinct_words"] = np.bincount(seen, minlength=n)
    return out


_CLASS = {"n_upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_digits": b"0123456789", "n_bangs": b"!?", "n_bars": b"|", "n_stops": b".,;:", "n_markup": b"#*$%&<>"}


def class_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Characters of a few ASCII classes in each text."""
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate(_CLASS.values()):
        kind[list(chars)] |= np.uint8(1 << k)
    found = kind[data]
    return {name: counts((found >> np.uint8(k)) & np.uint8(1), at) for k, name in enumerate(_CLASS)}


def entropy(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shannon entropy of each text's bytes in bits; 0 for an empty one."""
    n, size = len(at) - 1, np.diff(at)
    table = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=n * 256).reshape(n, 256)
    share = table / np.maximum(size, 1)[:, None]
    return -np.einsum("ij,ij->i", share, np.log2(np.where(share > 0, share, 1)))
