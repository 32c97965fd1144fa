"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are binned at training quantiles. Boosting goes round the features in cycles; each
step fits a shallow tree to one feature's gradient histogram and adds its leaves to that feature's
lookup table. Pairs with the largest remaining gain then get tables over coarse bin grids the
same way. A score is the sum of table entries at a text's bins, through a sigmoid: vectorised
bin additions, with no input but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.textkernel import SPACE, shingles, text_slices, tokenize

FEATURES = (
    "log_tokens", "token_bytes", "upper", "lower", "digits", "symbols", "stops", "non_ascii", "newlines",
    "symbol_tokens", "repeated", "distinct", "top_token", "distinct_shingles", "short_tokens", "line_tokens",
)
#: The learner takes at most so many labelled rows: those with the smallest md5 of their id.
SAMPLE = 20_000
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x61, 0x7B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[0x80:] = 6
_CLASS[0x0A] = 7


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document; an empty text gives zeros."""
    tokens = tokenize(data, offsets, SPACE)
    h, off = tokens.hashes, tokens.offsets
    n = np.diff(off)
    size, count = np.maximum(np.diff(offsets), 1), np.maximum(n, 1)
    kind = _CLASS[data]
    by_class = [_sums(kind == k, offsets) / size for k in range(1, 8)]
    symbol = np.concatenate([[0], np.cumsum(kind == 4, dtype=np.int64)])
    length = tokens.ends - tokens.starts
    symbol_token = _sums(symbol[tokens.ends] > symbol[tokens.starts], off) / count
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[off[:-1][n > 0]] = False
    grams, gram_off = shingles(tokens)
    distinct, top, distinct_grams = np.ones(len(n)), np.zeros(len(n)), np.ones(len(n))
    for i in np.flatnonzero(n):
        seen = np.unique(h[off[i] : off[i + 1]], return_counts=True)[1]
        distinct[i], top[i] = len(seen) / n[i], seen.max() / n[i]
        g = grams[gram_off[i] : gram_off[i + 1]]
        distinct_grams[i] = len(np.unique(g)) / len(g)
    lines = 1 + by_class[6] * size
    return np.column_stack([
        np.log1p(n), _sums(np.ones(len(data), bool), offsets) / count, *by_class[:7], symbol_token,
        _sums(same, off) / count, distinct, top, distinct_grams, _sums(length <= 2, off) / count, np.log1p(n / lines),
    ])


@dataclass
class Model:
    """Bin edges and lookup tables per feature, and grids per feature pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.intercept)
        if self.edges and len(x):
            b = self.bins(x)
            for j, table in enumerate(self.tables):
                total += table[b[:, j]]
            for (i, j), grid in zip(self.pairs, self.grids):
                total += grid[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values by bin of a shallow tree on a gradient histogram."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -1.0)
        k = int(np.argmax(gain))
        if gain[k] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1, ridge, least), _tree(g[k + 1 :], h[k + 1 :], depth - 1, ridge, least)])
    return np.full(len(g), -g.sum() / (h.sum() + ridge))


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """The best depth-2 tree on a grid: one axis first, the other axis within each half."""
    best, out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(a)):
            leaves = [_tree(a[s].sum(0), b[s].sum(0), 1, ridge, least) for s in (slice(0, k), slice(k, None))]
            value = np.vstack([np.broadcast_to(leaves[0], (k, a.shape[1])), np.broadcast_to(leaves[1], (len(a) - k, a.shape[1]))])
            gain = -(2 * a * value + b * value**2).sum()
            if gain > best:
                best, out = gain, value if axis == 0 else value.T
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, n_pairs: int = 4, bins: int = 32, grid: int = 6, rate: float = 0.1, ridge: float = 2.0, least: float = 1.0) -> Model:
    """Learns from rows of FEATURES and 0/1 labels; without rows every score is one half."""
    model = Model()
    if not len(y):
        return model
    rate0 = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(rate0 / (1 - rate0)))
    model.edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [(np.arange(len(e) + 1) * grid) // (len(e) + 1) for e in model.edges]
    b = model.bins(x)
    f = np.full(len(y), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = gradient()
            step = rate * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), 2, ridge, least)
            table += step
            f += step[b[:, j]]
    g, h = gradient()
    cells = {(i, j): model.coarse[i][b[:, i]] * grid + model.coarse[j][b[:, j]] for i, j in combinations(range(x.shape[1]), 2)}
    gains = {}
    for pair, cell in cells.items():
        gg, hh = (np.bincount(cell, v, grid * grid).reshape(grid, grid) for v in (g, h))
        v = _grid_tree(gg, hh, ridge, least)
        gains[pair] = -(2 * gg * v + hh * v**2).sum()
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.grids = [np.zeros((grid, grid)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for pair, table in zip(model.pairs, model.grids):
            g, h = gradient()
            step = rate * _grid_tree(*(np.bincount(cells[pair], v, grid * grid).reshape(grid, grid) for v in (g, h)), ridge, least)
            table += step
            f += step.ravel()[cells[pair]]
    return model


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the labelled documents that are not held out (null ids are never learnt from).

    Repeated labels of an id count as their mean, repeated documents of an id as the one with the smallest
    features. At most ``sample`` labelled ids go to the learner, one row each, chosen by the md5 of the
    id, so the sample is a fixed one at any size. Without labelled documents every score is one half.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("gam_label"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(known), "doc_id").select("text", "gam_label", F.col("doc_id").cast("string").alias("gam_id"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1)
            for i, j, data, offsets in text_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(features(data, offsets).tolist(), pa.list_(pa.float64())), label[i:j], batch.column(2)[i:j]], names=["x", "y", "id"])

    got = rows.mapInArrow(stream, "x array<double>, y int, id string").groupBy("id", "y").agg(F.min("x").alias("x")).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the order of arrival is not part of the model
    return train(x[order], y[order])


def scores(column: pa.Array, model: Model) -> np.ndarray:
    parts = [model.score(features(data, offsets)) for _, _, data, offsets in text_slices(column)]
    return np.round(np.concatenate(parts), 9) if parts else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts score as empty ones.

    Extra columns are not read; a null id is scored and counts as not held out; repeated rows stay rows
    with equal scores; very long texts are read whole; an empty table gives none.
    """
    model = fit(docs, labels)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(batch.column(2), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(stream, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns as they are, whatever their
    names. Null texts are judged as empty ones; null ids are judged like others; repeated rows stay or go
    together; very long texts are read whole; an empty table gives none."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), model) >= THRESHOLD))

    return docs.mapInArrow(stream, docs.schema)
