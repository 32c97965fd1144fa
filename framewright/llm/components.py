"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed

#: Edges of one task, and the least number of tasks. Rounds run in as many tasks as their edges need,
#: not in the session's shuffle partitions, whose near-empty files would outweigh the edges.
TASK_EDGES, LEAST_TASKS = 250_000, 6


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    ``edges`` has columns a and b (longs). The number of rounds grows with the logarithm of the
    longest path; each round writes its edges to the checkpoint folder.
    """
    pairs = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state, before = _state(pairs), None
    for _ in range(max_rounds):
        if state == before:
            break
        tasks = max(LEAST_TASKS, -(-2 * state[0] // TASK_EDGES))
        pairs = pairs.coalesce(tasks)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(lows, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).coalesce(tasks)
        linked = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        star = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = linked.select(F.explode(star).alias("e")).select("e.a", "e.b").filter("a <> b").coalesce(tasks)
        pairs = checkpointed(small.distinct().coalesce(tasks))
        before, state = state, _state(pairs)
    else:
        raise RuntimeError("components did not settle")
    out = pairs.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())


def _state(pairs: DataFrame) -> tuple:
    """The number of edges and a sum over them; a round that changes neither has settled."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
