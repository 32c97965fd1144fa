"""Mixing sources to target weights by capped water-filling.

Sources get targets in proportion to their weights; a source whose target passes its cap
(``max_epochs`` of its own words) is clamped there and the excess goes to the others by weight,
until none is above. So a target is the smaller of the cap and the weight times one level, which
aggregates over the table of sources find. A target of e epochs becomes floor(e) whole repetitions of
each document and one fractional repetition: documents in the order of a seeded hash until the rest
of the target is used up; the document on the edge gives its first words only, so a source's words
meet its target exactly (rounded).

Only slim rows (source, hash, size) are shuffled: their sums by hash prefix show in which bucket each
source's edge lies, and that bucket's rows show the edge. Documents are then compared with their
source's edge where they are, so a hot source is dealt like any other, and no number of sources is
too large.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Edges of so many sources are broadcast to the documents; more are joined by source.
MAX_BROADCAST = 100_000
_SOURCE = ["mix_source", "mix_null"]
_PLACE = ["mix_hash", "mix_words", "mix_tie"]


def words(text: Column) -> Column:
    """Number of maximal runs without space, tab, LF, VT, FF or CR (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(clamped: Callable[[float], tuple[int, float]], size: int, weight: float, total: float, max_epochs: float) -> float:
    """The level l for which the targets min(cap, l x weight) add up to ``total``; infinite if all caps don't.

    ``size`` and ``weight`` are those of all sources, ``clamped(l)`` those of the sources whose cap is at
    most l x weight. The level only rises from round to round, until no more are clamped."""
    if total >= max_epochs * size:
        return math.inf
    level, before = total / weight, None
    while (found := clamped(level)) != before:
        before = found
        level = (total - max_epochs * found[0]) / (weight - found[1])
    return level


def water_fill(sizes: list[int], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """Targets of a list of sources."""

    def clamped(level: float) -> tuple[int, float]:
        over = [i for i, s in enumerate(sizes) if max_epochs * s <= level * weights[i]]
        return sum(sizes[i] for i in over), sum(weights[i] for i in over)

    level = water_level(clamped, sum(sizes), sum(weights), total, max_epochs)
    return [max_epochs * s if math.isinf(level) else min(max_epochs * s, level * w) for s, w in zip(sizes, weights)]


def source_plan(slim: DataFrame, weights: tuple, share: float, max_epochs: float) -> tuple[DataFrame, int, int]:
    """(source with its size, target, whole repetitions and rest; number of sources; rows of the largest)."""
    sums = slim.groupBy(*_SOURCE).agg(F.sum("mix_words").alias("mix_source_size"), F.count("*").alias("mix_rows"))
    ordered = checkpointed(sums.orderBy("mix_null", "mix_source").withColumn("mix_id", F.monotonically_increasing_id()))
    runs = ordered.groupBy(F.shiftright("mix_id", 33).alias("mix_run")).agg(F.count("*").alias("mix_n"))  # one row a task of the sort
    before = Window.orderBy("mix_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("mix_run", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_start"))
    rank = F.col("mix_start") + F.col("mix_id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = ordered.join(F.broadcast(runs), F.shiftright("mix_id", 33) == F.col("mix_run")).select(*_SOURCE, "mix_source_size", "mix_rows", weight.alias("mix_weight"))
    cap = F.col("mix_source_size") * F.lit(float(max_epochs))
    total = ranked.agg(F.sum("mix_source_size").alias("size"), F.sum("mix_weight").alias("weight"), F.count("*").alias("n"), F.max("mix_rows").alias("rows")).first()

    def clamped(level: float) -> tuple[int, float]:
        found = ranked.filter(cap <= F.lit(level) * F.col("mix_weight")).agg(F.sum("mix_source_size"), F.sum("mix_weight")).first()
        return found[0] or 0, found[1] or 0.0

    size = total["size"] or 0
    level = water_level(clamped, size, total["weight"], share * size, max_epochs) if size else math.inf
    target = F.round(cap if math.isinf(level) else F.least(cap, F.lit(level) * F.col("mix_weight")), 6)
    plan = ranked.withColumn("mix_target", target)
    goal = F.least(F.floor(F.col("mix_target") + 0.5), F.floor(cap)).cast("long")
    whole = F.when(F.col("mix_source_size") > 0, F.expr("mix_goal div mix_source_size")).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("mix_goal", goal).withColumn("mix_whole", whole).withColumn("mix_rest", F.expr("mix_goal - mix_whole * mix_source_size"))
    return plan.drop("mix_rows", "mix_weight", "mix_goal"), total["n"], total["rows"] or 0


def edges(slim: DataFrame, plan: DataFrame, depth: int) -> DataFrame:
    """(source, mix_edge, mix_part, mix_nth, mix_equal): the document in which the rest of a source's target
    is used up, the words it gives, and which of how many equal rows it is. Sources without a rest have none."""
    keyed = slim.withColumn("mix_bucket", F.substring("mix_hash", 1, depth))
    sums = keyed.groupBy(*_SOURCE, "mix_bucket").agg(F.sum("mix_words").alias("mix_sum"))
    before = Window.partitionBy(*_SOURCE).orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("mix_start", F.coalesce(F.sum("mix_sum").over(before), F.lit(0))).join(plan.select(*_SOURCE, "mix_rest"), _SOURCE)
    starts = starts.filter("mix_rest > 0 AND mix_start < mix_rest AND mix_rest <= mix_start + mix_sum").drop("mix_sum")
    rows = keyed.join(starts, [*_SOURCE, "mix_bucket"])
    inside = Window.partitionBy(*_SOURCE).orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*_SOURCE, *_PLACE)
    rows = rows.withColumn("mix_start", F.col("mix_start") + F.coalesce(F.sum("mix_words").over(inside), F.lit(0)))
    rows = rows.withColumn("mix_nth", F.row_number().over(same.orderBy("mix_start"))).withColumn("mix_equal", F.count("*").over(same))
    rows = rows.filter("mix_start < mix_rest AND mix_rest <= mix_start + mix_words")
    return rows.select(*_SOURCE, F.struct(*_PLACE).alias("mix_edge"), F.expr("mix_rest - mix_start").alias("mix_part"), "mix_nth", "mix_equal")


def mix(
    docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", tie: Column | None = None, weights: tuple = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, per_bucket: int = 8192
) -> DataFrame:
    """(mix_row, mix_words, mix_source_size, mix_target, mix_whole, mix_part, mix_taken) of every row: the row
    itself as a struct, so that no name of its columns clashes, and what the mix takes of it.

    Sources are ordered by code point with null last and take ``weights`` in turn; they share
    ``share`` x all words. Rows equal in the hash are ordered by size and ``tie`` (by default the whole
    row's hash); equal rows are interchangeable. Null ids are one id. Rows without words take 0. An
    empty table gives an empty result.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(
        F.struct(*every).alias("mix_row"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source"), F.col(source).isNull().alias("mix_null"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("mix_hash"), size.alias("mix_words"), (F.xxhash64(*every) if tie is None else tie).alias("mix_tie"),
    )
    slim = checkpointed(keyed.drop("mix_row"))
    plan, n, rows = source_plan(slim, weights, share, max_epochs)
    depth = max(0, math.ceil(math.log(max(1, rows / per_bucket), 16)))
    plan = checkpointed(plan.join(edges(slim, plan, depth), _SOURCE, "left").drop("mix_rest"))
    placed = keyed.join(F.broadcast(plan) if n <= MAX_BROADCAST else plan, _SOURCE)
    place = F.struct(*_PLACE)
    part = F.when(place < F.col("mix_edge"), F.col("mix_words")).when(place == F.col("mix_edge"), F.col("mix_part")).otherwise(F.lit(0))
    split = (F.col("mix_equal") > 1) & (place == F.col("mix_edge"))
    if plan.filter("mix_equal > 1").limit(1).count():  # the edge is one of equal rows: the ones before it give all their words, the ones after it none
        nth = F.row_number().over(Window.partitionBy(*_SOURCE).orderBy("mix_hash"))
        equal = placed.filter(split).withColumn("mix_nth_own", nth)
        own = F.when(F.col("mix_nth_own") < F.col("mix_nth"), F.col("mix_words")).when(F.col("mix_nth_own") == F.col("mix_nth"), F.col("mix_part")).otherwise(F.lit(0))
        equal = equal.withColumn("mix_part", own.cast("long")).drop("mix_nth_own")
        placed = placed.filter(~F.coalesce(split, F.lit(False))).withColumn("mix_part", F.coalesce(part, F.lit(0)).cast("long")).unionByName(equal)
    else:
        placed = placed.withColumn("mix_part", F.coalesce(part, F.lit(0)).cast("long"))
    return placed.select("mix_row", "mix_words", "mix_source_size", "mix_target", "mix_whole", "mix_part", F.expr("mix_whole * mix_words + mix_part").alias("mix_taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix of ``documents`` with production parameters, one row per document row: doc_id, size,
    source_size, target, taken.

    Null and empty texts have size 0 and take 0; null ids are one id of the hash's order; repeated rows are
    rows of their own; very long texts are counted whole; extra columns are not read; an empty table gives none."""
    sized = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("n"), F.xxhash64("text").alias("h")))
    mixed = mix(sized, F.col("n"), tie=F.col("h"))
    return mixed.select(F.col("mix_row.doc_id").alias("doc_id"), F.col("mix_words").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def repeated(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as many times as it is taken whole, and the edge document's
    first words once; columns are those of ``docs``, whatever their names, and ``n_chars``, if there, is
    that of the words given. Documents without words (null and empty texts too) are not in a mix
    unless their source is taken whole, when they repeat like the rest. Null ids and repeated rows are
    rows like others; long texts are repeated whole; an empty table gives none."""
    mixed = mix(docs, words(F.col("text")), seed=seed, tie=F.xxhash64("text"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("mix_row.text"), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("mix_part").cast("int")), " ")
    full = (F.col("mix_part") == F.col("mix_words")) & (F.col("mix_words") > 0)
    some = (F.col("mix_part") > 0) & ~full
    copies = F.col("mix_whole") + F.col("mix_part").cast("boolean").cast("long")
    rows = mixed.filter(copies > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    edge = some & (F.col("mix_copy") > F.col("mix_whole"))
    rows = rows.withColumn("mix_cut", F.when(edge, cut))
    out = []
    for name in docs.columns:
        column = F.col(f"mix_row.`{name}`")
        if name == "text":
            column = F.coalesce(F.col("mix_cut"), column)
        elif name == "n_chars":
            column = F.when(F.col("mix_cut").isNull(), column).otherwise(F.length("mix_cut").cast(docs.schema[name].dataType))
        out.append(column.alias(name))
    return rows.select(*out)
