"""N-gram Jaccard join with signature trees.

Sets are the distinct five-word shingles of whole texts, as 64-bit hashes. Documents with equal
sets are collapsed first; the rest meet in buckets of shared keys, and inside a bucket a signature
tree joins them: nodes hold the OR of their documents' token bitmaps and a size range, and a dual
traversal drops node pairs whose largest possible overlap cannot reach the threshold. What is
left is counted exactly.

Keys lose no link. (a) Every set emits its ``KEYS`` smallest hashes (all of its prefix
``n - ceil(0.8 n) + 1``, if that is less). Two linked sets share 4/5 of their union, so they share
none of these keys with probability under 0.2 ^ KEYS (7e-12), and surely share one when the prefix
is whole. (b) Shingles that very many documents hold (common lines, passages) make no buckets at
(a). Sets with such a shingle among their keys emit their whole prefix in the order (rare first,
then common), which finds every link by the prefix principle, so that documents which only share a
passage do not meet in its bucket.

Pairs that could be linked by the bitmaps' bound (about four bits a shingle) join sets into coarse
groups; all links lie inside them. This takes two rounds over the buckets, each of which gives only
pairs that connect something: first each set's first two shared keys, then every bucket that still
holds several coarse groups, from which only sets go that meet another group's set of a size that can be
linked, in slices, so that their bitmaps' copies never lie on disk all at once. Then each set goes once, whole, to its coarse group, where a finer tree
and exact counts find the links. Large buckets are dealt in blocks and pairs of blocks, so none has to
fit a task. A large group is dealt in blocks of so many bytes and sets, each with about ``LEADS`` of the
group's sets as well, which connects nearly all of a group of near copies; then only what isn't in the
group's largest component meets the rest, so sets are copied in proportion to their number.

``keys=None`` gives every set its whole prefix, which needs no probability at a cost of more keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed, tidy
from framewright.llm.components import connected_components
from framewright.llm.textkernel import SPACE, mix64, shingles, text_slices, tokenize

WORDS, PERCENT, KEYS, ROUND_KEYS = 5, 80, 16, 2
#: At most so many common shingles are broadcast (8 bytes each).
MAX_COMMON = 1 << 20
BLOCK, WIDE_BLOCK, EXACT_BLOCK, FANOUT = 512, 2048, 4096, 8
#: Bytes of whole sets in one block of a coarse group, and how many of its sets meet all blocks.
EXACT_BYTES, LEADS = 16 << 20, 64
#: Up to so many rows of sets' cells (32 bytes each) are broadcast to the documents; beyond, a filter of their
#: ids is (16 bits each, 32 MB at most), and only the texts that pass it are shuffled to meet them.
MAX_BROADCAST_IDS, MAX_FILTER_BITS, SEGMENT, FILTER_SEEDS = 1 << 19, 1 << 28, 1 << 16, (5, 6)
#: Sizes that can be linked lie in the same class or in neighbouring ones (above 100 / PERCENT, so rounding is safe).
SIZE_STEP = 1.26
#: The second round's bitmaps go in slices of so many bytes, or of so many times the bytes of all sets' bitmaps.
SLICE_BYTES, SLICE_MAPS = 256 << 20, 2


def document_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; null and empty texts have none."""
    for first, _, data, offsets in text_slices(column):
        grams, off = shingles(tokenize(data, offsets, SPACE), WORDS)
        for d in range(len(off) - 1):
            yield first + d, np.unique(grams[off[d] : off[d + 1]])


def common_shingles(docs: DataFrame, max_common: int = MAX_COMMON, least: int = 64) -> np.ndarray:
    """Shingles that at least max(least, all / max_common) documents hold, so never more than
    ``max_common``; counted by task over runs of documents, dropping what a run holds under 8 times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        room, total = 2 << 20, 0

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= 8
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often]), pa.nulls(int(often.sum()), pa.int64())], names=["shingle", "n", "total"])

        size = 0
        for batch in batches:
            for _, s in document_sets(batch.column(0)):
                held.append(s)
                size += len(s)
                total += len(s)
                if size >= room:
                    yield flush()
                    held, size = [], 0
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["shingle", "n", "total"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "shingle long, n long, total long")
    counts = checkpointed(counts.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = counts.agg(F.sum("total")).first()[0] or 0
    rows = counts.filter(F.col("shingle").isNotNull() & (F.col("n") >= max(least, math.ceil(total / max_common)))).select("shingle").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def set_keys(s: np.ndarray, common: np.ndarray, keys: int | None = KEYS) -> np.ndarray:
    """The keys of one sorted set, see the module's text."""
    p = prefix_length(len(s))
    first = s[: p if keys is None else min(p, keys)]
    if not len(common):
        return first
    is_common = common[np.minimum(np.searchsorted(common, first), len(common) - 1)] == first
    if not is_common.any():
        return first
    flags = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.unique(np.concatenate([first[~is_common], np.concatenate([s[~flags], s[flags]])[:p]]))


def keyed_sets(docs: DataFrame, common: np.ndarray, n_keys: int | None = KEYS) -> DataFrame:
    """(doc_id, n, fp1, fp2, keys, map) per row: two 64-bit digests of the set, its keys and its bitmap."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, keys, maps = [], [], [], [], []
            for _, s in document_sets(batch.column(1)):
                n.append(len(s))
                f1.append(mix64(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64))
                f2.append(mix64(s ^ np.uint64(0x5C5C)).sum(dtype=np.uint64))
                keys.append(set_keys(s, common, n_keys).view(np.int64) if len(s) else np.zeros(0, np.int64))
                maps.append(bitmap(s, bits_for(len(s))).tobytes() if len(s) else None)
            if n:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), lists, pa.array(maps, pa.binary())], names=["doc_id", "n", "fp1", "fp2", "keys", "map"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(stream, "doc_id long, n long, fp1 long, fp2 long, keys array<long>, map binary")


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit (hash mod bits) of each element, as uint64 words."""
    out = np.zeros(bits, bool)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap folded by OR to fewer bits (both are powers of two)."""
    return np.bitwise_or.reduce(words.reshape(-1, bits // 64), axis=0)


def bits_for(n: int, each: int = 4) -> int:
    return min(1 << 16, max(64, 1 << (each * n - 1).bit_length()))


class SignatureTree:
    """Documents sorted by size under nodes of OR-combined bitmaps, size ranges and bit excess.

    Two members share at most popcount(AND) + min(excess) elements, where a set's excess is its
    size less its own bits; a node has its members' largest excess."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        excess = sizes - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
        self.levels = [(bitmaps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > FANOUT:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        b, lo, hi, ex = self.levels[level]
        ok = (100 * hi[i] >= PERCENT * lo[j]) & (100 * hi[j] >= PERCENT * lo[i])
        at = np.flatnonzero(ok)
        step = max(1, (1 << 21) // b.shape[1])
        for k in range(0, len(at), step):
            p = at[k : k + step]
            most = np.bitwise_count(b[i[p]] & b[j[p]]).sum(1).astype(np.int64) + np.minimum(ex[i[p]], ex[j[p]])
            most = np.minimum(most, np.minimum(hi[i[p]], hi[j[p]]))
            ok[p] = (100 + PERCENT) * most >= PERCENT * (lo[i[p]] + lo[j[p]])
        return ok

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (i, j), i < j, of all pairs that could reach the threshold: a dual traversal from the root."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        i, j = np.triu_indices(n)
        yield from self._descend(top, i, j)

    def _descend(self, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            keep = i < j
            i, j = i[keep], j[keep]
        ok = self._possible(level, i, j)
        i, j = i[ok], j[ok]
        if level == 0:
            yield i, j
            return
        below = len(self.levels[level - 1][0])
        step = np.arange(FANOUT)
        for k in range(0, len(i), 4096):
            a = (i[k : k + 4096, None, None] * FANOUT + step[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
            b = (j[k : k + 4096, None, None] * FANOUT + step[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
            a, b = a.ravel(), b.ravel()
            keep = (a <= b) & (b < below)
            yield from self._descend(level - 1, a[keep], b[keep])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = overlap(a, b)
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def exact_links(ids: list[int], sets: list[np.ndarray], given: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is linked among these sets, by a signature tree of 16 bits a shingle
    and exact counts; pairs already connected, by links found or by components ``given``, aren't counted."""
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    cuts = [0, *(k for k in range(1, len(order)) if 100 * len(sets[order[k - 1]]) < PERCENT * len(sets[order[k]])), len(order)]
    for begin, end in zip(cuts[:-1], cuts[1:]):  # runs of sizes that can be linked
        band = order[begin:end]
        if len(band) < 2:
            continue
        sizes = np.array([len(sets[k]) for k in band], np.int64)
        bits = bits_for(int(sizes[-1]), 16)
        tree = SignatureTree(sizes, np.stack([bitmap(sets[k], bits) for k in band]))
        label = np.unique([given[k] for k in band], return_inverse=True)[1] if given else np.arange(len(band))
        for i, j in tree.pairs():
            while len(i):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                for x, y in zip(i[:512].tolist(), j[:512].tolist()):
                    if label[x] != label[y] and linked(sets[band[x]], sets[band[y]]):
                        label[label == label[y]] = label[x]
                        yield ids[band[x]], ids[band[y]]
                i, j = i[512:], j[512:]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, across batches."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _pair_stream(join: Callable) -> Callable:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for pair in join(batches):
            out.append(pair)
            if len(out) >= 20_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return stream


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tree_of(rows: list[tuple]) -> tuple[np.ndarray, SignatureTree]:
    """(ids, tree) of rows (id, size, bitmap, ..) sorted by size."""
    maps = [np.frombuffer(r[2], np.uint64) for r in rows]
    bits = min(m.size for m in maps) * 64
    return np.array([r[0] for r in rows], np.int64), SignatureTree(np.array([r[1] for r in rows], np.int64), np.stack([fold(m, bits) for m in maps]))


def _size_bands(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows sorted by size, cut into runs whose sizes can all be linked with the run's first; each two
    neighbouring runs together, so all pairs that can be linked share a band, and a band's bitmaps are
    folded to at least half of what its largest set would have."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    runs: list[list[tuple]] = []
    for r in rows:
        if not runs or 100 * runs[-1][0][1] < PERCENT * r[1]:
            runs.append([])
        runs[-1].append(r)
    lone = True  # the last run has met none before it
    for a, b in zip(runs, [*runs[1:], []]):
        if b and 100 * a[-1][1] >= PERCENT * b[0][1]:
            yield a + b
            lone = False
        else:
            if lone:
                yield a
            lone = True


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
    """Pairs of a block that could be linked, but none that such pairs connect already."""
    for _, rows in _groups(batches, 2):
        for band in _size_bands(list({(r[0], r[2]): r for r in rows}.values())):
            if len(band) > 1:
                ids, tree = _tree_of(band)
                union = _Union(len(ids))
                for i, j in tree.pairs():
                    for x, y in zip(i.tolist(), j.tolist()):
                        if (p := union.find(x)) != (q := union.find(y)):
                            union.join(p, q)
                            yield int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
    """Pairs that could be linked and connect coarse groups, of one pair of blocks (equal: within the block)."""
    for (_, left, right), rows in _groups(batches, 3):
        for band in _size_bands(list({(r[0], r[2]): r for r in rows}.values())):
            comps, place = np.unique([r[3] for r in band], return_inverse=True)
            if len(comps) < 2:
                continue
            ids, tree = _tree_of(band)
            block = np.array([r[4] for r in band], np.int64)
            union = _Union(len(comps))
            for i, j in tree.pairs():
                keep = (place[i] != place[j]) & ((block[i] != block[j]) if left != right else np.ones(len(i), bool))
                for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                    if (p := union.find(int(place[x]))) != (q := union.find(int(place[y]))):
                        union.join(p, q)
                        yield int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))


def _exact_round(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
    """Links inside a cell of a coarse group; rows have the component that is known."""
    for _, rows in _groups(batches, 3):
        rows = list({(r[0], r[1]): r for r in rows}.values())
        if len(rows) > 1:
            yield from exact_links([r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows], [r[2] for r in rows])


def _in_cells(rows: DataFrame, key: str, held: str, size: int) -> DataFrame:
    """Rows dealt to pairs of blocks (left, right) of about ``size`` rows of their key; small keys have one."""
    cells = F.ceil(F.col(held) / size).cast("int")
    rows = rows.withColumns({"cells": cells, "block": F.pmod(F.xxhash64("node", F.lit(2)), cells).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return rows.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("cells", "other", held)


def id_filter(nodes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(bitmap, bits): two bits for each of about ``n`` nodes, put together in segments by the executors."""
    bits = min(MAX_FILTER_BITS, max(SEGMENT, 1 << (16 * n - 1).bit_length()))
    at = F.explode(F.array(*(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(bits)) for seed in FILTER_SEEDS)))
    held = nodes.select(at.alias("bit")).select((F.col("bit") / SEGMENT).cast("int").alias("segment"), (F.col("bit") % SEGMENT).cast("int").alias("bit"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1):
                mask = np.zeros(SEGMENT, bool)
                mask[row.values.to_numpy()] = True
                out.append(np.packbits(mask, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["segment", "held"])

    rows = held.groupBy("segment").agg(F.collect_set("bit").alias("bits")).mapInArrow(build, "segment int, held binary").toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for segment, mask in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        out[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(mask, np.uint8)
    return out, bits


def _passed(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Rows (node, text) whose node passes the filter of ``nodes``: all of theirs, and a few per cent of others."""
    held, bits = id_filter(nodes, n)
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for k in range(len(FILTER_SEEDS)):
                at = batch.column(2 + k).to_numpy()
                ok &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield batch.select([0, 1]).filter(pa.array(ok))

    hashes = [F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(bits)).alias(f"h{seed}") for seed in FILTER_SEEDS]
    return rows.filter("node IS NOT NULL").select("node", "text", *hashes).mapInArrow(keep, "node long, text string")


def _linked_in(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Links found in cells (component, left, right, node, known): the documents' texts meet their cells,
    go there once, and are made sets there, as a text takes less room than its set."""
    names = ["component", "left", "right", "node", "set", "known"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                out = [s.tobytes() for _, s in document_sets(batch.column(4))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary()), batch.column(5)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    n = cells.count()
    if n <= MAX_BROADCAST_IDS:
        dealt = rows.join(F.broadcast(cells), "node")
    else:
        dealt = _passed(rows, cells, n).hint("merge").join(cells.hint("merge"), "node")
    dealt = dealt.select("component", "left", "right", "node", "text", "known").repartition("component", "left", "right").sortWithinPartitions("component", "left", "right", "node")
    return dealt.mapInArrow(_pair_stream(lambda batches: _exact_round(stream(batches))), "a long, b long")


def exact_components(docs: DataFrame, coarse: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, component) of the linked sets among coarse groups (node, component); ``sizes`` has node and n."""
    rows = coarse.join(sizes, "node").withColumn("bytes", 8 * F.col("n"))
    held = rows.groupBy("component").agg(F.count("*").alias("held"), F.sum("bytes").alias("total"))
    blocks = lambda total, n: F.greatest(F.ceil(F.col(total) / EXACT_BYTES), F.ceil(F.col(n) / EXACT_BLOCK)).cast("int")
    rows = checkpointed(rows.join(held.select("component", "held", blocks("total", "held").alias("blocks")), "component").select("node", "component", "bytes", "held", "blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    lead = F.pmod(F.xxhash64("node", F.lit(3)), F.col("held")) < LEADS
    cells = rows.select("component", F.explode(F.when((F.col("blocks") > 1) & lead, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("left"), F.lit(-1).alias("right"), "node", F.col("node").alias("known"))
    links = checkpointed(_linked_in(docs, cells))
    comps = checkpointed(connected_components(links))
    large = rows.filter("blocks > 1")
    if not large.limit(1).count():
        return comps
    known = large.join(comps.withColumnRenamed("component", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
    parts = known.groupBy("component", "known").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    parts = parts.groupBy("component").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.max(F.struct("n", "known", "b")).alias("m"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    parts = parts.select("component", "main", (F.col("n") - F.col("m.n")).alias("n_rest"), (F.col("b") - F.col("m.b")).alias("b_rest"), F.col("m.n").alias("n_main"), F.col("m.b").alias("b_main"))
    parts = parts.filter("n_rest > 0").select("component", "main", blocks("b_rest", "n_rest").alias("k_rest"), blocks("b_main", "n_main").alias("k_main"))
    # blocks 0 to k_rest - 1 hold the rest and meet each other and all of the main component's, which don't meet each other
    dealt = known.join(parts, "component").withColumn("is_main", F.col("known") == F.col("main"))
    dealt = dealt.withColumn("block", (F.pmod(F.xxhash64("node", F.lit(4)), F.when(F.col("is_main"), F.col("k_main")).otherwise(F.col("k_rest"))) + F.when(F.col("is_main"), F.col("k_rest")).otherwise(F.lit(0))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("k_rest")).otherwise(F.col("k_rest") + F.col("k_main")) - 1)))
    cells = dealt.select("component", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node", "known")
    return checkpointed(connected_components(links.unionByName(_linked_in(docs, cells))))


def _size_class() -> Column:
    return F.floor(F.log(F.col("n")) / math.log(SIZE_STEP)).cast("int")


def _open_members(members: DataFrame, coarse: DataFrame) -> DataFrame:
    """(key, node, n, component, held) of the members that meet a set of another coarse group, of a size they
    could be linked with, under their key; keys of more than ``WIDE_BLOCK`` such sets are parted by sizes."""
    placed = members.join(coarse, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"), _size_class().alias("class"))
    beside = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class")
    near = placed.groupBy("key", "class").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).select("key", beside, "lo", "hi")
    near = near.groupBy("key", "class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("key", "class")
    rest = placed.join(near, ["key", "class"], "left_semi")
    rest = rest.join(rest.groupBy("key").agg(F.count("*").alias("held")), "key")
    wide = F.col("held") > WIDE_BLOCK
    rest = rest.withColumn("window", F.explode(F.when(wide, F.array(F.col("class") - 1, F.col("class"))).otherwise(F.array(F.lit(None).cast("int")))))
    rest = rest.select(F.when(wide, F.xxhash64("key", "window")).otherwise(F.col("key")).alias("key"), "node", "n", "component")
    return rest.join(rest.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"), "key")


def _second_pairs(rest: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs that connect coarse groups under the open keys; slices of the keys go one after the other, each
    with a bounded share of the copies of bitmaps, and leave only their pairs."""
    room = F.least(F.col("n"), F.lit(8192)) + 64
    copies = rest.agg(F.sum(F.ceil(F.col("held") / WIDE_BLOCK) * room)).first()[0] or 0
    slices = max(1, -(-int(copies) // max(SLICE_BYTES, SLICE_MAPS * int(maps.agg(F.sum(room)).first()[0] or 0))))
    found = None
    for k in range(slices):
        part = rest.filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(slices)) == k).drop("n")
        dealt = _in_cells(part, "key", "held", WIDE_BLOCK).join(maps, "node").select("key", "left", "right", "node", "n", "map", "component", "block")
        dealt = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "node")
        pairs = checkpointed(dealt.mapInArrow(_pair_stream(_second_round), "a long, b long").distinct())
        found = pairs if found is None else found.unionByName(pairs)
    return found


def coarse_groups(reps: DataFrame) -> DataFrame:
    """(node, component) of sets (node, n, keys, map) that could be linked by their bitmaps, in two rounds over
    the buckets; the tables of the rounds are let go with it."""
    maps = reps.select("node", "n", "map")
    exploded = reps.select("node", "n", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("held"), F.min("node").alias("lead")).filter("held > 1")
    members = checkpointed(exploded.join(shared, "key"))

    firsts = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, ROUND_KEYS).alias("own"))
    followers = members.drop("n").join(firsts, "node").filter(F.array_contains("own", F.col("key")) & (F.col("node") != F.col("lead"))).drop("own")
    chosen = followers.unionByName(followers.select("key", F.col("lead").alias("node"), "held", "lead").distinct())
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own_block = F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks).cast("int")))
    chosen = chosen.select("key", F.explode(own_block).alias("block"), "node").join(maps, "node").select("key", "block", "node", "n", "map")
    chosen = chosen.repartition("key", "block").sortWithinPartitions("key", "block", "node")
    first = checkpointed(chosen.mapInArrow(_pair_stream(_first_round), "a long, b long").distinct())
    coarse = checkpointed(connected_components(first))

    rest = checkpointed(_open_members(members, coarse))
    second = _second_pairs(rest, maps)
    return checkpointed(connected_components(first.unionByName(second)))


def components(docs: DataFrame, keys: int | None = KEYS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Null and empty texts and texts without words have an empty set and are their own component. Rows of
    one doc_id count as one document that has all their sets; rows without an id are linked with nothing
    and have a null component. Very long texts are read whole. Extra columns are not read; an empty table
    gives none. ``keys``: how many of its smallest shingles a set meets others by; None for its whole prefix.
    """
    keyed = checkpointed(keyed_sets(docs, common_shingles(docs), keys))
    filled = keyed.filter("n > 0 AND doc_id IS NOT NULL")
    reps = filled.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "keys", "map")).alias("rep"))
    reps = checkpointed(reps.select("fp1", "fp2", "n", F.col("rep.doc_id").alias("node"), "rep.keys", "rep.map"))
    comps = exact_components(docs, coarse_groups(reps), reps.select("node", "n"))

    of_set = reps.select("fp1", "fp2", "n", "node").join(comps, "node", "left").select("fp1", "fp2", "n", F.coalesce("component", "node").alias("component"))
    found = filled.select("doc_id", "fp1", "fp2", "n").join(of_set, ["fp1", "fp2", "n"])
    alone = keyed.filter("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"))
    return found.select("doc_id", "n", "component").unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose doc_id is not among the distinct ``ids``, and those whose is. Rows stay where they are: the ids
    are broadcast, or else a filter of them is, and only rows that pass it are shuffled to meet them."""
    n = ids.count()
    if n <= MAX_BROADCAST_IDS:
        return tuple(docs.join(F.broadcast(ids), "doc_id", kind) for kind in ("left_anti", "left_semi"))
    held, bits = id_filter(ids.select(F.col("doc_id").alias("node")), n)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def passes(one: pd.Series, other: pd.Series) -> pd.Series:
        ok = np.ones(len(one), bool)
        for at in (one.to_numpy(), other.to_numpy()):
            ok &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    suspect = passes(*(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(bits)) for seed in FILTER_SEEDS))
    met = docs.filter(suspect).hint("merge")
    out = docs.filter(~suspect).unionByName(met.join(ids.hint("merge"), "doc_id", "left_anti").select(*docs.columns))
    return out, met.join(ids.hint("merge"), "doc_id", "left_semi").select(*docs.columns)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest id; all columns are kept, whatever
    their names. Rows without an id all stay, as do null and empty texts; of repeated rows of an id one
    stays. An empty table gives none."""
    found = checkpointed(components(docs).filter("doc_id IS NOT NULL"))
    tidy(docs.sparkSession, 0)
    kept, _ = _parted(docs, found.filter("doc_id <> component_id").select("doc_id").distinct())
    kept = kept.select(*docs.columns)
    again = found.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.limit(1).count():
        once, repeated = _parted(kept, again)
        kept = once.select(*docs.columns).unionByName(repeated.select(*docs.columns).dropDuplicates(["doc_id"]))
    return kept
