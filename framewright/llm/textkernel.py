"""Vectorised tokens over Arrow string columns: 64-bit token and shingle hashes by document.

A token's hash is a polynomial over a table of random 64-bit values by byte (upper case maps to
lower case), taken from prefix sums, so no Python object is made per token. Texts are worked
through in slices of a few MB; one slice's arrays bound the memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15

#: Byte classes: separators of words by white space, and of words by ASCII punctuation as well.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
PUNCT[0x41:0x5B] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


_BYTES = _byte_table()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out, step = np.ones(1, np.uint64), base
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step % (1 << 64)
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Tokens:
    """Tokens of consecutive documents: hash, first byte and end byte in ``data``; document i has
    tokens ``offsets[i]`` to ``offsets[i + 1]``."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; null is empty."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def tokenize(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Tokens:
    """Tokens of documents laid end to end; none crosses a document's end."""
    word = ~separators[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left = np.empty(n, bool)
    right = np.empty(n, bool)
    if n:
        left[0], right[-1] = True, True
        left[1:] = ~word[:-1] | edge[1:n]
        right[:-1] = ~word[1:] | edge[1:n]
    starts = np.flatnonzero(word & left)
    ends = np.flatnonzero(word & right) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # a run of tokens of about SLICE bytes, so that the tables of powers stay small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        begin, end = int(starts[at]), int(ends[to - 1])
        up, down = _powers(end - begin)
        sums = np.empty(end - begin + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data[begin:end]] * up[: end - begin], out=sums[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        hashes[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return Tokens(data, hashes, starts, ends, np.searchsorted(starts, offsets))


def shingles(tokens: Tokens, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of every place of n consecutive tokens; a shorter document gives its
    whole sequence as one, a document without tokens none. Places keep their order."""
    h, off = tokens.hashes, tokens.offsets
    counts = np.diff(off)
    places = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_off = np.concatenate([[0], np.cumsum(places)])
    if not out_off[-1]:
        return np.zeros(0, np.uint64), out_off
    doc = np.repeat(np.arange(len(counts)), places)
    at = off[doc] + (np.arange(out_off[-1]) - out_off[doc])
    out = np.zeros(len(at), np.uint64)
    width = np.minimum(counts, n)[doc]
    for k in range(n):
        inside = k < width
        step = h[np.minimum(at + k, len(h) - 1)] * np.uint64(pow(_BASE, 2 * k + 1, 1 << 64))
        out += step if inside.all() else np.where(inside, step, np.uint64(0))
    return mix64(out + width.astype(np.uint64)), out_off


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``tokenize`` gives these words."""
    column = pa.array([" ".join(words)], pa.large_string())
    _, _, data, offsets = next(text_slices(column))
    return tokenize(data, offsets, SPACE).hashes
