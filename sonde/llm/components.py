"""Connected components of an edge table by alternating large-star and small-star steps, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import remove, spread_join, staged_at


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link each node's greater (large) or smaller neighbours, and itself, to the least node around it; a hub's links are dealt out."""
    if large:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c"))
    joined = spread_join(around, least, ["a"], total, ["b"])
    moved = joined.where("b > a") if large else joined
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of ``edges`` (a, b). Nodes without edges are not listed.

    Each round's table is deleted once the next one is written.
    """
    now, path = staged_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    seen = mark(now)
    while seen[0]:
        before = path
        now, path = staged_at(_star(_star(now, True, seen[0]), False, seen[0]), "edges")
        remove(edges.sparkSession, before)
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
