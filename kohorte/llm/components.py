"""Connected components by alternating large and small stars: joins and grouped minima, no driver state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kohorte.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    turned = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(a, b): each node of ``edges`` that isn't the smallest of its component, and that smallest node."""
    now = scratch.keep(edges.where("a <> b").select("a", "b"), f"{label}-0")
    before, k = None, 0
    while True:
        k += 1
        seen = Observation()     # filled while the round is written
        now = scratch.keep(_small_star(_large_star(now)).observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("mark")), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        state = seen.get
        if state == before:
            return now
        before = state
