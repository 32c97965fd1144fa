"""Benchmark decontamination by SimHash over item-sized windows.

For every item length, windows of as many words slide over each whole text. A window is
fingerprinted if enough of its five-word shingles occur in any item at all to reach the
threshold (counted by prefix sums, so nothing that could reach it is left out). Fingerprints of
256 bits are looked up among the items of that length in a multi-index: each of ``BLOCKS`` blocks
has a table from 16-bit values to items, where an item stands under its own value and all that differ
from it in one bit; a window probes its own value and all that differ from it in one or two. Two
fingerprints within ``RADIUS`` differ in at most three bits of one of the blocks, so no item within the
radius is missed. Candidates are checked by their whole distance, then
verified by exact weighted-shingle similarity (sum of minima over sum of maxima of shingle counts). A document shorter than an item is one window
(``short``; without it such a document leaks nothing of that item). Items are taken in blocks of a bounded number
of bytes, each block against all documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.textkernel import PUNCT, Tokens, mix64, text_slices, tokenize

WORDS, THRESHOLD, BITS, BLOCKS, RADIUS = 5, 0.8, 256, 16, 63
#: A block is 16 bits. Changes to a block that an item is stored under and that a window probes: together
#: all of up to RADIUS // BLOCKS bits.
_BLOCK_BITS, _STORED_BITS = BITS // BLOCKS, 1
_STORED, _PROBED = (np.array([m for m in range(1 << _BLOCK_BITS) if m.bit_count() <= k], np.uint32) for k in (_STORED_BITS, RADIUS // BLOCKS - _STORED_BITS))
#: Bytes of items in one block; a task's tables of it take about ten times as much.
ITEM_BYTES = 8 << 20


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n tokens from each place on (the last n - 1 places have none)."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1)
    return mix64(out)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """BITS values of +1 or -1 for each shingle."""
    words = np.stack([mix64(shingles ^ np.uint64(0x51A5 * (k + 1))) for k in range(BITS // 64)], 1)
    return np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """BITS // 8 bytes for each row of bit sums."""
    return np.packbits(sums > 0, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle sequences, by counts."""
    keys = np.union1d(a, b)
    x = np.searchsorted(a, keys, "right") - np.searchsorted(a, keys)
    y = np.searchsorted(b, keys, "right") - np.searchsorted(b, keys)
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class MultiIndex:
    """Tables from each block's values to fingerprints. Only the fingerprints are shipped; a task
    builds the tables when it first asks."""

    def __init__(self, prints: np.ndarray):
        self.prints = np.ascontiguousarray(prints)
        self.present = None

    def __getstate__(self) -> dict:
        return {"prints": self.prints, "present": None}

    def _build(self) -> None:
        keys = (self._keys(self.prints)[:, :, None] ^ _STORED).reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], (order // (BLOCKS * len(_STORED))).astype(np.int32)
        self.present = np.zeros(BLOCKS << _BLOCK_BITS, bool)
        self.present[self.keys] = True

    @staticmethod
    def _keys(prints: np.ndarray) -> np.ndarray:
        """(fingerprint, block): the block's number and value."""
        values = np.ascontiguousarray(prints).view(np.uint16).astype(np.uint32)
        return values | (np.arange(BLOCKS, dtype=np.uint32) << np.uint32(_BLOCK_BITS))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (window, row) that are near in one of the blocks at least."""
        if self.present is None:
            self._build()
        own, found = self._keys(prints), []
        each = BLOCKS * len(_PROBED)
        for at in range(0, len(own), 64):
            probes = (own[at : at + 64, :, None] ^ _PROBED).reshape(-1)
            hits = np.flatnonzero(self.present[probes])
            w, keys = hits // each, probes[hits]
            left, right = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            n = right - left
            places = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else left
            found.append(np.unique(np.repeat(w + at, n) * len(self.prints) + self.rows[places]))
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pairs // len(self.prints), pairs % len(self.prints)

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row, distance) of all pairs within RADIUS."""
        w, i = self.candidates(prints)
        d = np.bitwise_count(np.ascontiguousarray(prints).view(np.uint64)[w] ^ self.prints.view(np.uint64)[i]).sum(1, dtype=np.int32)
        near = d <= RADIUS
        return w[near], i[near], d[near]


class Index:
    """Fingerprints and shingles of a block of items, by item length in words."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD, short: bool = False):
        self.threshold, self.short = threshold, short
        self.ids = [i for i, _ in items]
        by_length: dict[int, list] = defaultdict(list)
        known: dict[int, list] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            for _, _, data, offsets in text_slices(pa.array([text], pa.string())):
                h = tokenize(data, offsets, PUNCT).hashes
                if len(h):
                    g = grams(h, min(WORDS, len(h)))
                    by_length[len(h)].append((k, np.sort(g), _fingerprints(_signs(g).sum(0, keepdims=True))[0]))
                    known[min(WORDS, len(h))].append(g)
        self.lengths = {n: ([k for k, _, _ in rows], [s for _, s, _ in rows], MultiIndex(np.stack([f for _, _, f in rows]))) for n, rows in sorted(by_length.items())}
        self.known = {n: np.unique(np.concatenate(g)) for n, g in known.items()}
        self.table = {}
        for n, g in self.known.items():
            self.table[n] = np.zeros(1 << 20, bool)
            self.table[n][g & np.uint64((1 << 20) - 1)] = True

    def search(self, tokens: Tokens) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(document, item, similarity, start word, words, distance): each document's best window per item."""
        h, off = tokens.hashes, tokens.offsets
        best: dict[tuple[int, int], tuple] = {}
        for width, known in self.known.items():
            g = grams(h, width)
            maybe = np.flatnonzero(self.table[width][g & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(known, g[maybe]), len(known) - 1)
            hits = maybe[known[at] == g[maybe]]
            docs = np.searchsorted(off, hits, "right") - 1
            inside = hits + width <= off[docs + 1]
            hits, docs = hits[inside], docs[inside]
            cuts = np.flatnonzero(np.diff(docs)) + 1
            for group, own in zip(np.split(hits, cuts), np.split(docs, cuts)):
                if len(group):
                    d = int(own[0])
                    self._document(d, g[off[d] : off[d + 1] - width + 1], group - off[d], width, best)
        for (d, k), (s, start, n, apart) in sorted(best.items()):
            yield d, k, -s, start, n, apart

    def _document(self, d: int, g: np.ndarray, hits: np.ndarray, width: int, best: dict) -> None:
        hit = np.zeros(len(g) + 1, np.int64)
        hit[hits + 1] = 1
        hit = np.cumsum(hit)
        for n, (rows, sets, prints) in self.lengths.items():
            full = n - width + 1
            if min(WORDS, n) != width or full > len(g) and not (self.short and len(g) >= full * self.threshold - 1e-9):
                continue
            m = min(full, len(g))
            need = math.ceil((full + m) * self.threshold / (1 + self.threshold) - 1e-9)
            starts = np.flatnonzero(hit[m:] - hit[:-m] >= need) if m < len(hit) else np.zeros(0, int)
            for part in np.array_split(starts, -(-len(starts) // 4096)) if len(starts) else ():
                for run in np.split(part, np.flatnonzero(np.diff(part) > 4 * m) + 1):
                    a, b = int(run[0]), int(run[-1]) + m
                    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(g[a:b]), 0, dtype=np.int32)])
                    w, i, apart = prints.lookup(_fingerprints(sums[run - a + m] - sums[run - a]))
                    for w1, i1, d1 in zip(w.tolist(), i.tolist(), apart.tolist()):
                        start = int(run[w1])
                        s = similarity(np.sort(g[start : start + m]), sets[i1])
                        if s >= self.threshold - 1e-12:
                            key, value = (d, rows[i1]), (-s, start, m + width - 1, d1)
                            best[key] = min(best.get(key, value), value)


def item_blocks(items: DataFrame, item_bytes: int = ITEM_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about ``item_bytes``, dealt by a hash of the id (null ids are items too)."""
    total = items.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 16)).first()[0] or 0
    n = max(1, math.ceil(total / item_bytes))
    for b in range(n):
        rows = items.select("item_id", F.col("text").cast("string").alias("text")).filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r[0], r[1]) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int"


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, short: bool = False) -> DataFrame:
    """One row per document row and item that it leaks: the best window's similarity (ties: the
    first), its first word and words, and the fingerprints' distance.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty
    texts leak nothing, items without words are found nowhere; repeated items are items of their own
    and repeated documents rows of their own; null ids are carried. Very long texts are worked through
    window by window; extra columns are not read; an empty table on either side gives no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
    found = None
    for block in item_blocks(items):
        index = Index(block, threshold, short)

        def stream(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, _, data, offsets in text_slices(batch.column(1)):
                    out = [(first + d, index.ids[k], round(s, 9), start, n, apart) for d, k, s, start, n, apart in index.search(tokenize(data, offsets, PUNCT))]
                    if out:
                        cols = list(zip(*out))
                        ids = batch.column(0).take(pa.array(cols[0]))
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:]))], names=names)

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(stream, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def find_all_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``find_leaks`` with documents shorter than an item as windows of their own."""
    return find_leaks(docs, items, short=True)


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, short: bool = False) -> DataFrame:
    """The documents that leak no item, with their columns as they are, whatever their names.

    Null and empty texts leak nothing and stay, as do null ids; repeated rows stay or go together; a long
    text goes if any window leaks. Without items all rows stay; an empty table gives none.
    """
    column = docs.columns.index("text")
    for block in item_blocks(items):
        index = Index(block, threshold, short)

        def stream(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in text_slices(batch.column(column)):
                    for d, *_ in index.search(tokenize(data, offsets, PUNCT)):
                        clean[first + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(stream, docs.schema)
    return docs
