"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge table of longs; component is the smallest node reachable.

    Every round is two aggregations and two joins over at most as many edges as before, written to the
    workspace; the driver holds two numbers a round. Rows with a null end and loops are ignored; an empty
    table gives an empty result. A hub's rows are spread by the adaptive split of skewed joins.
    """
    now = work.write(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges-0")
    mark = None
    for k in range(1, max_rounds + 1):
        step = work.write(_small_star(_large_star(now)), f"edges-{k}")
        work.drop(f"edges-{k - 1}")
        seen = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = step
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
    raise RuntimeError(f"components still change after {max_rounds} rounds")
