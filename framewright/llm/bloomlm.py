"""LM scoring with a log-frequency Bloom filter.

A bigram model's quantised counts live in one Bloom filter: an n-gram of level q is inserted
with each of 1..q, and its level is read back by membership probes 1, 2, .. until one fails.
Words and word pairs have level 1 + floor(log2 c). A text's probability comes from interpolated estimates
(1 - l) p(w) + l c(v, w) / c(v), with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and p(w) alone after a word
that isn't known. A pair's count is its level's smallest, a word's in the numerator too, and a history's its
level's largest (frequent words have exact counts), so that the estimates of the words that were seen after
one never sum above one; false positives, at most 3 % of unseen pairs, add to that. Where words are
frequent, a score is at most log10 2 a token below the one by exact counts, and above it only by these.

The weight l depends on the history's level. Each is fitted to all training texts, every token being
left out of its own counts: tasks sum a histogram of the two estimates' ratio, which is all that the
likelihood depends on.

Counts are exact and cover all training texts. Tasks count runs of texts and deal their sorted
hashes as blobs by the hash's top bits; the task that owns a part sums it, gives its words' counts
and fills its own segment of the filter, so segments need no merging. A segment has ``LEAST_BITS``
to twice as many bits for each level inserted, whatever the corpus's size. A filter of at most
``MAX_BITS`` bits is broadcast. A larger one stays in its segments: texts are dealt to runs, a run
asks each part for the levels of its distinct n-grams, and the answers go back to the run.
The ``MAX_TOP`` most frequent words' counts are broadcast; for the base score, the remaining
words' counts are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed
from framewright.llm.textkernel import SPACE, Tokens, mix64, text_slices, tokenize

PROBES = 3
#: Bins of the histogram that weights are fitted to: so many an octave of the ratio, octaves on either side.
RATIO_BINS, RATIO_OCTAVES = 4, 60
#: Tokens of all levels' histogram that are added to each level's own.
PRIOR = 1000
#: Bits of the filter for each inserted level, at least; twice as many at most.
LEAST_BITS = 8
#: Bounds of what is broadcast: 64 MB of filter, 1 M words of 16 bytes.
MAX_BITS, MAX_TOP = 1 << 29, 1 << 20
#: Parts that counts are dealt in: about PART_BYTES of text each.
PART_BYTES, MAX_PARTS = 8 << 20, 1 << 18
#: Low bytes of a key that name it within its part.
KEY_BYTES = 5
END = np.uint64(0x454E44454E44454E)
_RUN = 1 << 20


def with_ends(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's tokens and one end."""
    counts = np.diff(tokens.offsets) + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.uint64)
    last = np.zeros(len(out), bool)
    last[offsets[1:] - 1] = True
    out[last], out[~last] = END, tokens.hashes
    return out, offsets


def pairs(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; the first of a text follows an end."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[offsets[:-1]] = END
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + hashes)


def _positions(keys: np.ndarray, level: int, probe: int, shift: int, segment_bits: int) -> np.ndarray:
    """Bit positions in the whole filter: the segment by the key's top bits, the bit by a mix."""
    inside = mix64((keys & np.uint64((1 << 8 * KEY_BYTES) - 1)) + np.uint64((level * 0x9E3779B97F4A7C15 + probe * 0xC2B2AE3D27D4EB4F + 1) % (1 << 64))) & np.uint64(segment_bits - 1)
    return (keys >> np.uint64(shift) if shift < 64 else keys * np.uint64(0)) * np.uint64(segment_bits) + inside


@dataclass
class Filter:
    """A segmented log-frequency Bloom filter over 64-bit keys."""

    words: np.ndarray
    parts: int
    segment_bits: int

    @property
    def shift(self) -> int:
        return 64 - (self.parts.bit_length() - 1)

    def insert(self, keys: np.ndarray, levels: np.ndarray, first_part: int = 0) -> None:
        """Adds keys with levels 1..q; ``words`` may be the segments from ``first_part`` on."""
        level = 1
        while len(keys := keys[levels >= level]):
            levels = levels[levels >= level]
            for probe in range(PROBES):
                at = _positions(keys, level, probe, self.shift, self.segment_bits) - np.uint64(first_part * self.segment_bits)
                np.bitwise_or.at(self.words, (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))
            level += 1

    def levels(self, keys: np.ndarray, most: int = 48) -> np.ndarray:
        """Each key's level, by probing until one fails."""
        out = np.zeros(len(keys), np.int64)
        active = np.arange(len(keys))
        for level in range(1, most + 1):
            for probe in range(PROBES):
                at = _positions(keys[active], level, probe, self.shift, self.segment_bits)
                active = active[(self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(active):
                break
            out[active] = level
        return out


@dataclass
class Answers:
    """Levels of a run's sorted n-grams, as the parts gave them."""

    keys: np.ndarray
    found: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)].astype(np.int64)


def smallest(levels: np.ndarray) -> np.ndarray:
    """The smallest count of a level (0 below the first)."""
    return np.where(levels > 0, 2.0 ** (levels - 1), 0.0)


def largest(levels: np.ndarray) -> np.ndarray:
    """The largest count of a level (0 below the first)."""
    return np.where(levels > 0, 2.0**levels - 1, 0.0)


@dataclass
class Model:
    filter: Filter | Answers | None
    total: int
    distinct: int
    top: np.ndarray
    top_counts: np.ndarray
    weights: np.ndarray | None = None

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def learnt(key: str = "doc_id"):
    """Training rows: crc32 of the id as text mod 5 is not 1 (null ids are learnt from)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 != 1, F.lit(True))


def _plan(docs: DataFrame) -> int:
    """The number of parts for these texts, a power of two."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 16)).first()[0] or 1
    return min(MAX_PARTS, 1 << max(0, (size // PART_BYTES).bit_length()))


def _owned(values: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the runs of sorted keys that belong to one part."""
    owner = (values >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64) if parts > 1 else np.zeros(len(values), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(values)]])
    return ((int(owner[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]))


def short_keys(keys: np.ndarray) -> bytes:
    """The low bytes of keys, which name them within their part."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def long_keys(blob: bytes) -> np.ndarray:
    keys = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    keys[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return keys.view(np.uint64)[:, 0]


def count_ngrams(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (word, n) of every training word's exact count, and rows (part, segment) of the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, arrays in enumerate(held):
                values, n = np.unique(np.concatenate(arrays), return_counts=True)
                blobs = [(part, kind, (short_keys if kind else np.ndarray.tobytes)(values[a:b]), n[a:b].astype(np.uint32).tobytes()) for part, a, b in _owned(values, parts)]
                for at in range(0, len(blobs), 4096):
                    cols = zip(*blobs[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "kind", "keys", "counts"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                h, off = with_ends(tokenize(data, offsets, SPACE))
                held[0].append(h)
                held[1].append(pairs(h, off))
                size += len(h)
                if size >= _RUN:
                    yield from flush()
                    held, size = [[], []], 0
        if size:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kind = None, None
        blobs: list[tuple[bytes, bytes]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([long_keys(k) | np.uint64(part << (64 - (parts.bit_length() - 1)) if parts > 1 else 0) if kind else np.frombuffer(k, np.uint64) for k, _ in blobs])
            n = np.concatenate([np.frombuffer(c, np.uint32) for _, c in blobs]).astype(np.int64)
            blobs.clear()
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(n, first)
            held.append((keys, np.floor(np.log2(n)).astype(np.int64) + 1))
            if kind == 0:
                for at in range(0, len(keys), 100_000):
                    k = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n[at : at + 100_000]), pa.nulls(len(k), pa.int32()), pa.nulls(len(k), pa.binary())], names=["word", "n", "part", "segment"])

        def segment() -> pa.RecordBatch:
            segment_bits = max(64, 1 << (LEAST_BITS * sum(int(q.sum()) for _, q in held) - 1).bit_length())
            bits = Filter(np.zeros(segment_bits // 8, np.uint8), parts, segment_bits)
            for k, q in held:
                bits.insert(k, q, part)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([bits.words.tobytes()], pa.binary())], names=["word", "n", "part", "segment"])

        for batch in batches:
            for p, k, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (p, k) != (part, kind) and blobs:
                    yield from close()
                if p != part:
                    if part is not None:
                        yield segment()
                    part = p
                kind = k
                blobs.append((keys, counts))
        if blobs:
            yield from close()
        if part is not None:
            yield segment()

    blobs = docs.filter(learnt()).select(F.col("text").cast("string")).mapInArrow(count, "part int, kind int, keys binary, counts binary")
    dealt = blobs.repartition(parts, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(add, "word long, n long, part int, segment binary")


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, the table (word, n) of the words that are not among its most frequent ones, the
    table (part, segment) of its filter, and the number of parts. Above ``MAX_BITS`` the model has no filter."""
    parts = _plan(docs)
    counts = checkpointed(count_ngrams(docs, parts))
    words = counts.filter("word IS NOT NULL").select("word", "n")
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    sizes = sorted(((r[0], r[1]) for r in words.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count("*")).collect()), reverse=True)
    kept, level = 0, None
    for at, n in sizes:
        if kept + n > MAX_TOP:
            break
        kept, level = kept + n, at
    is_top = F.floor(F.log2("n") * 8) >= F.lit(level if level is not None else 1 << 30)
    top = words.filter(is_top).toArrow()
    keys = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    segments = counts.filter("part IS NOT NULL").select("part", "segment")
    size = segments.agg(F.max(F.octet_length("segment"))).first()[0] or 8
    bits = None
    if parts * size * 8 <= MAX_BITS:
        words_of = np.zeros((parts, size), np.uint8)
        for r in segments.toLocalIterator():
            own = np.frombuffer(r["segment"], np.uint8)
            words_of[r["part"]] = np.tile(own, size // len(own))  # sizes are powers of two, so a repeated segment answers as the segment
        bits = Filter(words_of.reshape(-1), parts, size * 8)
    model = Model(bits, total or 0, distinct or 0, keys[order], top.column("n").to_numpy().astype(np.int64)[order])
    return model, words.filter(~is_top), segments, parts


def run_keys(column: pa.ChunkedArray) -> np.ndarray:
    """The sorted distinct words and pairs of these texts."""
    found = []
    for _, _, data, offsets in text_slices(column):
        h, off = with_ends(tokenize(data, offsets, SPACE))
        found.append(np.unique(np.concatenate([h, pairs(h, off)])))
    return np.unique(np.concatenate(found))


def answered(rows: DataFrame, segments: DataFrame, parts: int) -> DataFrame:
    """(run, part, levels) of each run's n-grams, one byte each in the order of their keys."""

    def ask(table: pa.Table) -> pa.Table:
        keys = run_keys(table.column("text"))
        blobs = [(part, short_keys(keys[a:b])) for part, a, b in _owned(keys, parts)]
        run = table.column("run")[0].as_py()
        return pa.table({"run": pa.array([run] * len(blobs), pa.int64()), "part": pa.array([b[0] for b in blobs], pa.int32()), "keys": pa.array([b[1] for b in blobs], pa.binary())})

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        levels = []
        if asked.num_rows and held.num_rows:
            own = np.frombuffer(held.column("segment")[0].as_py(), np.uint8)
            bits = Filter(own, 1, len(own) * 8)
        for blob in asked.column("keys").to_pylist():
            levels.append(bits.levels(long_keys(blob)).astype(np.uint8).tobytes() if held.num_rows else bytes(len(blob) // KEY_BYTES))
        return pa.table({"run": asked.column("run"), "part": asked.column("part"), "levels": pa.array(levels, pa.binary())})

    asked = rows.groupBy("run").applyInArrow(ask, "run long, part int, keys binary")
    return asked.groupBy("part").cogroup(segments.groupBy("part")).applyInArrow(answer, "run long, part int, levels binary")


@dataclass
class Counted:
    """Counts of consecutive texts' tokens: the word's, its history's and the pair's, and exact ones of frequent words."""

    word: np.ndarray
    history: np.ndarray
    pair: np.ndarray
    exact: np.ndarray


def count_tokens(model: Model, h: np.ndarray, offsets: np.ndarray) -> Counted:
    unique, inverse = np.unique(h, return_inverse=True)
    exact = np.zeros(len(unique), np.int64)
    if len(model.top):
        at = np.minimum(np.searchsorted(model.top, unique), len(model.top) - 1)
        exact = np.where(model.top[at] == unique, model.top_counts[at], 0)
    levels = model.filter.levels(unique)
    low, high = (np.where(exact > 0, exact, edge(levels)) for edge in (smallest, largest))
    high_of = high[inverse]
    history = np.empty_like(high_of)
    history[1:] = high_of[:-1]
    history[offsets[:-1]] = high[np.searchsorted(unique, END)]
    pair = np.minimum(smallest(model.filter.levels(pairs(h, offsets))), history)
    return Counted(low[inverse], history, pair, exact[inverse])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def ratio_histogram(model: Model, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens by (history's level, bin of the estimates' ratio), each left out of its counts; bin 0: a ratio of 0."""
    c = count_tokens(model, h, offsets)
    some = c.history >= 2  # a history seen once tells nothing when it is left out
    alone = (np.maximum(c.word[some] - 1, 0) + 0.5) / model.denominator
    ratio = np.maximum(c.pair[some] - 1, 0) / (c.history[some] - 1) / alone
    place = np.clip(np.floor(np.log2(np.maximum(ratio, 1e-30)) * RATIO_BINS), -RATIO_OCTAVES * RATIO_BINS, RATIO_OCTAVES * RATIO_BINS - 1)
    place = np.where(ratio > 0, place + RATIO_OCTAVES * RATIO_BINS + 1, 0).astype(np.int64)
    width = 2 * RATIO_OCTAVES * RATIO_BINS + 1
    return np.bincount(level_of(c.history[some]) * width + place, minlength=64 * width).reshape(64, width)


def fitted_weights(histogram: np.ndarray) -> np.ndarray:
    """The likeliest weight of each history level; a level without tokens has the next one's (the last: the one before's)."""
    bins = histogram.shape[1] - 1
    ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(bins) - bins // 2 + 0.5) / RATIO_BINS)]) - 1
    every = histogram.sum(0)
    every = every * (PRIOR / every.sum()) if every.sum() else np.zeros(bins + 1)
    out = np.full(len(histogram), 0.5)
    for level, own in enumerate(histogram + every):
        lo, hi = 0.001, 0.999
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (own * ratio / (1 + mid * ratio)).sum() > 0 else (lo, mid)
        out[level] = lo
    seen = np.flatnonzero(histogram.sum(1))
    return out[seen[np.minimum(np.searchsorted(seen, np.arange(len(out))), len(seen) - 1)]] if len(seen) else out


def score_texts(model: Model, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per document: log10 probability, base part over known frequent words, their number, and a
    mask over tokens of the words left to join."""
    c = count_tokens(model, h, offsets)
    base = np.where(c.exact > 0, np.log10(c.exact + 0.5), 0.0)
    known = c.exact > 0
    alone = (c.word + 0.5) / model.denominator
    weight = np.where(c.history > 0, model.weights[level_of(c.history)], 0.0)
    p = (1 - weight) * alone + weight * c.pair / np.maximum(c.history, 1.0)
    begin = offsets[:-1]
    return np.add.reduceat(np.log10(p), begin), np.add.reduceat(base, begin), np.add.reduceat(known.astype(np.int64), begin), ~known


def answered_model(model: Model, texts: pa.Table, found: pa.Table) -> Model:
    """The model with the answers to one run's n-grams."""
    levels = b"".join(x for _, x in sorted(zip(found.column("part").to_pylist(), found.column("levels").to_pylist())))
    return replace(model, filter=Answers(run_keys(texts.column("text")), np.frombuffer(levels, np.uint8)))


def histogram_of(rows: DataFrame, shared: Broadcast, answers: DataFrame | None) -> np.ndarray:
    """``ratio_histogram`` summed over all training texts."""

    def add(model: Model, text: pa.Array, total: np.ndarray) -> None:
        for _, _, data, offsets in text_slices(text):
            total += ratio_histogram(model, *with_ends(tokenize(data, offsets, SPACE)))

    def table(total: np.ndarray) -> pa.RecordBatch:
        level, place = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(level), pa.array(place), pa.array(total[level, place])], names=["level", "place", "n"])

    empty = lambda: np.zeros((64, 2 * RATIO_OCTAVES * RATIO_BINS + 1), np.int64)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty()
        for batch in batches:
            add(shared.value, batch.column(0), total)
        yield table(total)

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        total = empty()
        add(answered_model(shared.value, texts, found), texts.filter(pc.invert(texts.column("held_out"))).column("text"), total)
        return pa.Table.from_batches([table(total)])

    schema = "level long, place long, n long"
    sums = rows.filter("NOT held_out").select("text").mapInArrow(stream, schema) if answers is None else rows.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(run, schema)
    out = empty()
    for level, place, n in sums.groupBy("level", "place").agg(F.sum("n")).collect():  # 64 levels, a fixed number of bins
        out[level, place] = n
    return out


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null and empty texts are one end. Words outside the training texts have count 0. Null ids are
    learnt from; repeated rows are learnt from and stay rows; extra columns are not read; very long texts
    are read whole. An empty table gives none.
    """
    model, rare, segments, parts = fit(docs)
    rows = docs.select("doc_id", (~learnt()).alias("held_out"), F.col("text").cast("string").alias("text"))
    answers = None
    if model.filter is None:
        rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).repartition(parts, "run")
        answers = checkpointed(answered(rows, segments, parts))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    weights = fitted_weights(histogram_of(rows, shared, answers))

    def score(batch: pa.RecordBatch, m: Model) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in text_slices(batch.column(2)):
            h, off = with_ends(tokenize(data, offsets, SPACE))
            score, base, known, left = score_texts(m, h, off)
            cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(left.astype(np.int64), off[:-1]))])
            rest = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h[left].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.diff(off)), pa.array(known), pa.array(base), pa.array(score), rest], names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest"]
            )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from score(batch, replace(shared.value, weights=weights))

    def score_run(texts: pa.Table, found: pa.Table) -> pa.Table:
        (batch,) = texts.select(["doc_id", "held_out", "text"]).combine_chunks().to_batches()
        return pa.Table.from_batches(score(batch, replace(answered_model(shared.value, texts, found), weights=weights)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>"
    part = rows.mapInArrow(stream, schema) if answers is None else rows.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(score_run, schema)
    part = checkpointed(part.withColumn("row", F.monotonically_increasing_id()))
    rest = part.select("row", F.explode("rest").alias("word")).join(rare, "word").groupBy("row").agg(F.count("*").alias("rest_known"), F.sum(F.log10(F.col("n") + 0.5)).alias("rest_base"))
    joined = part.withColumn("n_rest", F.size("rest")).drop("rest").join(rest, "row", "left")
    known = F.coalesce(F.col("rest_known"), F.lit(0))
    base = F.col("base") + F.coalesce("rest_base", F.lit(0.0)) + (F.col("n_rest") - known) * F.log10(F.lit(0.5)) - F.col("n_tokens") * F.log10(F.lit(model.denominator))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + known).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
