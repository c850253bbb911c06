"""Words and their 64-bit hashes for whole Arrow batches of texts, with numpy.

A batch is cut into slices of a few megabytes. In a slice every byte is
classified at once, word bounds fall out of the class changes, and a word's hash
is the difference of two prefix sums of a polynomial over its bytes, so the cost
per byte is a few vector operations whatever the word lengths are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _table(blank: set[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(blank)] = False
    return table


#: Words are runs of bytes other than space, tab, LF, VT, FF and CR.
BLANKS = _table({0x20, *range(0x09, 0x0E)})
#: Words are runs of digits, letters (after lower-casing) and non-ASCII bytes.
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE = np.random.RandomState(20240517).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=U)
    out[0] = 1
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * U(step)
        done += m
        step = pow(step, 2, 1 << 64)
    return out


_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        _POW["up"], _POW["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _POW["up"], _POW["down"]


@dataclass
class Slice:
    """Consecutive texts: their bytes, the words in them and whose they are."""

    first: int  # index in the batch of the first text
    n: int  # texts
    data: np.ndarray  # bytes (lower-cased if asked)
    bounds: np.ndarray  # n + 1 byte offsets
    start: np.ndarray  # of each word
    end: np.ndarray
    at: np.ndarray  # n + 1 word offsets: words of text i are at[i]:at[i + 1]
    hash: np.ndarray  # of each word


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(column: pa.Array, is_word: np.ndarray = BLANKS, lower: bool = True, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Words of every text of ``column``, a bounded number of bytes at a time (a longer text alone)."""
    off, raw = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        data = raw[off[i] : off[j]]
        if lower:
            data = LOWER[data]
        bounds = off[i : j + 1] - off[i]
        word = is_word[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[bounds] = True
        before = np.empty_like(word)
        if len(word):
            before[0] = False
            before[1:] = word[:-1]
            after = np.empty_like(word)
            after[-1] = False
            after[:-1] = word[1:]
            start = np.flatnonzero(word & (~before | cut[:-1]))
            end = np.flatnonzero(word & (~after | cut[1:])) + 1
        else:
            start = end = np.zeros(0, np.int64)
        up, down = _tables(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        yield Slice(i, j - i, data, bounds, start, end, np.searchsorted(start, bounds), mix((total[end] - total[start]) * down[start] + (end - start).astype(U)))
        i = j


def windows(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text: hash, text, first word.

    A text with fewer words, but with some, gives one run of all its words.
    """
    count = np.diff(part.at)
    n = len(part.hash)
    text = np.repeat(np.arange(part.n), count)
    value = np.zeros(n, dtype=U)
    for k in range(size):
        value[: max(0, n - k)] += mix(part.hash[k:] + U(k * 2 + 1)) * U(pow(_BASE, k + 1, 1 << 64))
    position = np.arange(n) - part.at[:-1][text] if n else np.zeros(0, np.int64)
    full = position + size <= count[text] if n else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        for t in short:
            h = part.hash[part.at[t] : part.at[t + 1]]
            k = np.arange(len(h))
            value[part.at[t]] = np.sum(mix(h + (k * 2 + 1).astype(U)) * up_powers(size)[: len(h)]) + U(len(h))
        full[part.at[short]] = True
    keep = np.flatnonzero(full)
    return mix(value[keep]), text[keep], position[keep]


def up_powers(n: int) -> np.ndarray:
    """The multipliers that ``windows`` gives to the words of a run."""
    return np.array([pow(_BASE, k + 1, 1 << 64) for k in range(n)], dtype=U)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's BIGINT."""
    return np.ascontiguousarray(x).view(np.int64)
