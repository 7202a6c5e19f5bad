"""Losses and their weights as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flops(activations: DataFrame, n_rows: int | Column, threshold: float = 30.0, most: float = 1.0) -> DataFrame:
    """loss of (term, value): |threshold - sum over terms of (mean over all rows of |value|) squared|, cut at ``most``."""
    n = F.lit(n_rows) if not isinstance(n_rows, Column) else n_rows
    by_term = activations.groupBy("term").agg((F.sum(F.abs("value")) / n).alias("mean"))
    return by_term.agg(F.least(F.greatest(F.abs(F.lit(threshold) - F.coalesce(F.sum(F.col("mean") * F.col("mean")), F.lit(0.0))), F.lit(0.0)), F.lit(most)).alias("loss"))


def triplet_flops(activations: DataFrame, triplets: DataFrame, threshold: float = 30.0, most: float = 1.0) -> DataFrame:
    """``flops`` of (key, term, value) over the rows of all anchors, positives and negatives (keys), a key as often as it stands there."""
    rows = triplets.select(F.explode(F.array("anchor", "positive", "negative")).alias("key"))
    n = rows.agg(F.count("*").alias("n"))
    weighted = rows.groupBy("key").agg(F.count("*").alias("times")).join(activations, "key").join(F.broadcast(n))
    return flops(weighted.select("term", (F.col("value") * F.col("times") / F.col("n")).alias("value")), 1, threshold, most)


def total(*parts: tuple[float, DataFrame]) -> DataFrame:
    """loss: the losses, each times its weight, added up."""
    weighted = [p.select((F.lit(w) * F.col("loss")).alias("loss")) for w, p in parts]
    return reduce(DataFrame.unionByName, weighted).agg(F.sum("loss").alias("loss"))


def flops_weight(step: Column, weight: float = 3e-6, steps: int = 10000) -> Column:
    """The weight that the step-th call (from 1) gets: it grows with the square of the step, which starts at 1 before the first call."""
    if steps <= 1:
        return F.lit(0.0)
    ratio = F.least(step + 1, F.lit(steps)) / F.lit(float(steps))
    return F.lit(weight) * ratio * ratio


def ranking(scores: DataFrame) -> DataFrame:
    """loss of (row, positive, negative...): mean cross-entropy of the positive among a row's scores, shifted by their maximum."""
    columns = [F.col(c) for c in scores.columns if c != "row"]
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    total = sum((F.exp(c - top) for c in columns), F.lit(0.0))
    return scores.agg(F.avg(F.log(total) + top - F.col("positive")).alias("loss"))
