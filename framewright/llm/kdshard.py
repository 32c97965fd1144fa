"""Sharding by K-d tree partitioning, in DataFrame expressions only.

Rows of one group (equal texts) are one point of the tree, so they share a shard; a group of more than
``WHOLE`` of a shard's bytes is cut by a hash of the id into many points, as no even shard could hold it.
A tree over the points' metadata dimensions is grown level by level. Each open node that must yield k
leaves is split at the weighted quantile floor(k/2)/k of its bytes along its widest dimension (extent
relative to the whole table's); points equal in it are ordered by a hash, so that a hot value is cut
like any other. All nodes of a level share one aggregate per refinement pass: points are binned between
their node's bounds, bytes are summed by (node, bin), and a window picks each node's bin that
straddles its target. One row for each node comes to the driver, and goes back as a broadcast table of
at most 2 x leaves rows, with which the points move on to their child nodes. A pass narrows a node's
bounds until the straddling bin's bytes are within ``tolerance`` of a leaf or belong to one point.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed, tidy

BINS = 1024
#: A group of up to this share of a shard's bytes stays whole; a larger one is cut into pieces of the other share.
WHOLE, PIECE = 0.25, 1 / 64
#: Bits of the hash that orders points equal in a dimension; dimensions are under 2^32.
TIE_BITS = 31
#: Levels after which the points' nodes are written, which cuts their lineage.
LEVELS = 6


@dataclass
class _Node:
    leaves: int
    first: int
    dim: int = 0
    left: float = 0.0
    lo: int = 0
    hi: int = 0
    cut: int | None = None


def _key(dims: list[str]) -> Column:
    """A point's place along its node's dimension: the value, then the hash."""
    return F.element_at(F.array(*dims), F.col("kd_dim")) * F.lit(1 << TIE_BITS) + F.col("kd_tie")


def _table(points: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """One row for each node, never more than the tree has; read from a literal, as local rows would start Python workers."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    kind = "array<struct<" + ",".join(x.replace(" ", ":") for x in schema.split(", ")) + ">>"
    return F.broadcast(points.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), kind))))


def grow(points: DataFrame, dims: list[str], size: str, leaves: int, tolerance: float = 0.01) -> DataFrame:
    """Adds ``shard`` to points: the leaf they fall into. dims are non-null BIGINT from -1 on, kd_tie is a hash."""
    stats = [f(c).alias(f"{n}_{i}") for i, c in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    placed = checkpointed(points.withColumn("kd_node", F.lit(1).cast("long")))
    whole = placed.agg(F.sum(size).alias("size"), *stats).first()
    if not whole["size"] or leaves == 1:
        return placed.withColumn("shard", F.lit(0)).drop("kd_node")
    extent = [max(1, whole[f"hi_{i}"] - whole[f"lo_{i}"]) for i in range(len(dims))]
    step = max(1.0, tolerance * whole["size"] / leaves)
    nodes = {1: _Node(leaves, 0)}
    for level in range(1, leaves.bit_length() + 1):
        here = {n: node for n, node in nodes.items() if n.bit_length() == level and node.leaves > 1}
        if not here:
            break
        tidy(points.sparkSession)
        open_ = _table(points, [(n,) for n in here], "kd_node long")
        rows = placed.join(open_, "kd_node").groupBy("kd_node").agg(F.sum(size).alias("size"), *stats).collect()
        goals = {}
        for r in rows:
            node = goals[r["kd_node"]] = here[r["kd_node"]]
            node.dim = max(range(len(dims)), key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / extent[d], -d))
            node.left = r["size"] * (node.leaves // 2) / node.leaves
            node.lo, node.hi = r[f"lo_{node.dim}"] << TIE_BITS, (r[f"hi_{node.dim}"] + 1) << TIE_BITS
        while bounds := {n: node for n, node in goals.items() if node.cut is None}:
            _refine(placed, bounds, dims, size, step)
        cuts = _table(points, [(n, node.dim + 1, node.cut) for n, node in goals.items()], "kd_node long, kd_dim int, kd_cut long")
        child = F.when(F.col("kd_cut").isNull(), F.col("kd_node")).otherwise(F.col("kd_node") * 2 + (_key(dims) >= F.col("kd_cut")).cast("long"))
        placed = placed.join(cuts, "kd_node", "left").withColumn("kd_node", child).drop("kd_dim", "kd_cut")
        if level % LEVELS == 0:
            placed = checkpointed(placed)
        for n, node in goals.items():
            half = node.leaves // 2
            nodes[2 * n], nodes[2 * n + 1] = _Node(half, node.first), _Node(node.leaves - half, node.first + half)
    shards = _table(points, [(n, node.first) for n, node in nodes.items() if node.leaves == 1], "kd_node long, shard int")
    return placed.join(shards, "kd_node").drop("kd_node")


def _refine(placed: DataFrame, bounds: dict[int, _Node], dims: list[str], size: str, step: float) -> None:
    """One pass for all open nodes: sums bytes by bin, then narrows each node's bounds or fixes its cut."""
    rows = [(n, b.dim + 1, b.lo, b.hi, max(1, -(-(b.hi - b.lo) // BINS)), b.left) for n, b in bounds.items()]
    spec = _table(placed, rows, "kd_node long, kd_dim int, kd_lo long, kd_hi long, kd_width long, kd_left double")
    binned = placed.join(spec, "kd_node").withColumn("kd_key", _key(dims)).filter("kd_key >= kd_lo AND kd_key < kd_hi")
    sums = binned.groupBy("kd_node", "kd_left", F.expr("(kd_key - kd_lo) div kd_width").alias("kd_bin")).agg(F.sum(size).alias("total"), F.min("kd_key").alias("lo"), F.max("kd_key").alias("hi"))
    upto = Window.partitionBy("kd_node").orderBy("kd_bin").rowsBetween(Window.unboundedPreceding, 0)
    straddling = sums.withColumn("upto", F.sum("total").over(upto)).filter("upto >= kd_left AND upto - total < kd_left")
    for r in straddling.select("kd_node", "total", "upto", "lo", "hi").collect():
        node, total = bounds[r["kd_node"]], r["total"]
        rest = node.left - (r["upto"] - total)
        if total <= step or rest <= step / 2 or total - rest <= step / 2 or r["lo"] == r["hi"]:
            node.cut = r["lo"] if rest < total - rest else r["hi"] + 1
        else:
            node.left, node.lo, node.hi = rest, r["lo"], r["hi"] + 1


def shard(
    table: DataFrame, dims: list[str], size: str, group: list[str], leaves: int | None = None, target_bytes: int | None = None, split: str | None = None, per_bucket: int = 50_000, tolerance: float = 0.01
) -> DataFrame:
    """Adds ``shard`` (int) and a gapless ``slot`` (long, from 0) to every row of ``table``.

    ``leaves`` fixes the number of shards; else it follows from ``target_bytes``. Rows equal in the
    ``group`` columns share a shard; a group of more than ``WHOLE`` of a shard's bytes is cut by a hash of
    ``split``, if that is given. Slots count through hash buckets of the rows, sized to about
    ``per_bucket`` rows, so no task has to number a whole shard. Empty tables give an empty result.
    Callers pass non-null BIGINT dims from -1 to 2^32 and non-null group columns; columns that start with
    ``kd_`` are this function's own.
    """
    totals = table.agg(F.count("*").alias("n"), F.sum(size).alias("size")).first()
    if leaves is None:
        leaves = max(1, math.ceil((totals["size"] or 0) / target_bytes))
    part, rest = F.lit(0), [c for c in dims if c not in group]
    if split is not None:
        share = max(1.0, (totals["size"] or 0) / leaves)
        large = table.groupBy(*group).agg(F.sum(size).alias("kd_size"), F.count("*").alias("kd_n")).filter((F.col("kd_size") > WHOLE * share) & (F.col("kd_n") > 1))
        # fewer than leaves / WHOLE groups
        large = large.select(*group, F.ceil(F.col("kd_size") / (PIECE * share)).cast("int").alias("kd_pieces"))
        table = table.join(F.broadcast(large), group, "left")
        part = F.coalesce(F.pmod(F.xxhash64(split, F.lit(11)), F.col("kd_pieces")), F.lit(0))
    table = table.withColumn("kd_part", part.cast("int"))
    key = [*group, "kd_part"]
    points = table.groupBy(*key).agg(F.sum(size).alias("kd_weight"), *[F.min(c).alias(f"kd_d{i}") for i, c in enumerate(rest)])
    points = points.withColumn("kd_tie", F.pmod(F.xxhash64(*key), F.lit(1 << TIE_BITS)))
    names = [c if c in group else f"kd_d{rest.index(c)}" for c in dims]
    placed = grow(points, names, "kd_weight", leaves, tolerance).select(*key, "shard")
    buckets = max(1, math.ceil(totals["n"] / leaves / per_bucket))
    numbered = [F.col(c) for c in (*key, *([split] if split else []), *rest, size)]
    placed = checkpointed(table.join(placed, key).withColumn("kd_bucket", F.pmod(F.xxhash64(*numbered), F.lit(buckets)).cast("int")))
    counts = placed.groupBy("shard", "kd_bucket").agg(F.count("*").alias("kd_n"))
    before = Window.partitionBy("shard").orderBy("kd_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "kd_bucket", F.coalesce(F.sum("kd_n").over(before), F.lit(0)).alias("kd_start"))
    inside = Window.partitionBy("shard", "kd_bucket").orderBy(*numbered)
    return (
        placed.withColumn("kd_slot", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "kd_bucket"])  # one row for per_bucket rows, or for a shard
        .withColumn("slot", (F.col("kd_start") + F.col("kd_slot") - 1).cast("long"))
        .drop("kd_bucket", "kd_start", "kd_slot", "kd_part", "kd_pieces")
    )


def shard_documents(docs: DataFrame, leaves: int = 40) -> DataFrame:
    """Shards ``documents`` by bytes: size is the text's UTF-8 bytes plus 16 (null text: 16).

    Dimensions are size, language and source (names by checksum; null is one more name; a group of equal
    texts has its smallest). Equal texts share a shard, unless they are more than a quarter of a shard's
    bytes together; null and empty texts are equal. Null ids count as one id; repeated rows stay rows and
    share a shard; a long text is one document, whatever its size. Extra columns are not read; an empty
    table gives none. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("kd_text"),
        F.coalesce(F.crc32(F.col("lang")), F.lit(-1).cast("long")).alias("kd_lang"),
        F.coalesce(F.crc32(F.col("source")), F.lit(-1).cast("long")).alias("kd_source"),
        F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("kd_id"),
    )
    placed = shard(checkpointed(table), ["size", "kd_lang", "kd_source"], "size", ["size", "text_crc32", "kd_text"], leaves=leaves, split="kd_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
