"""Connected components of a graph held as a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Edges for a task. Few edges are not dealt out over all shuffle partitions, each of which costs files in every round.
TASK_EDGES = 1 << 16


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(tasks)
    low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
    out = down.join(low, F.col("a") == F.col("x")).select("a", "b", "m")
    links = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("x").alias("a"), F.col("m").alias("b")))
    return links.filter("a <> b").coalesce(tasks).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for the nodes that have an edge. edges: a, b long. Each round is checkpointed."""
    now = cut_lineage(edges.select("a", "b").filter("a <> b").distinct())
    mark, n = None, now.count()
    for _ in range(max_rounds):
        tasks = math.ceil((n + 1) / TASK_EDGES)
        now = cut_lineage(_small_star(_large_star(now, tasks), tasks))
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(now.select("b", "b").distinct())
        mark, n = seen, seen["n"]
    raise RuntimeError("components did not settle")
