"""Retrieval metrics. run: query_id, key, rank (from 1); qrels: query_id, key, relevance. Queries of qrels without results count as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = ("ndcg@10", "hits@1", "hits@2", "hits@3", "hits@4", "hits@5", "hits@10")


def run_scores(run: DataFrame) -> DataFrame:
    """Similarities replaced by 1 - rank / n, ranks from 0."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return run.withColumn("score", 1 - (F.col("rank") - 1) / n)


def _value(metric: str) -> Column:
    """A query's value of a metric, as an aggregate of its judged results (rank, relevance, seen, best: the ideal's relevance at that rank)."""
    name, _, k = metric.partition("@")
    inside = F.col("rank") <= int(k) if k else F.lit(True)
    relevant = F.max("n_relevant")
    hit = (F.col("relevance") > 0) & inside
    got = F.sum(hit.cast("int"))
    size = F.lit(float(k)) if k else F.count("key")
    gain = lambda c: F.sum(F.when(inside, F.col(c) / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    how = {
        "ndcg": lambda: gain("relevance") / gain("best"),
        "map": lambda: F.sum(F.when(hit, F.col("seen") / F.col("rank")).otherwise(0.0)) / relevant,
        "mrr": lambda: F.max(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)),
        "r-precision": lambda: F.sum((hit & (F.col("rank") <= F.col("n_relevant"))).cast("int")) / relevant,
        "hits": lambda: got.cast("double"),
        "hit_rate": lambda: F.max(hit.cast("double")),
        "recall": lambda: got / relevant,
        "precision": lambda: F.when(size > 0, got / size).otherwise(0.0),
        "f1": lambda: 2 * got / (size + relevant),
    }
    if name not in how:
        raise ValueError(f"unknown metric {metric!r}")
    return F.coalesce(how[name](), F.lit(0.0))


def evaluate(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = DEFAULT) -> DataFrame:
    """metric, value: the mean over the queries that have a relevant key; all metrics come from one aggregate a query.

    A query's results and its ideal ranking are laid side by side, by rank.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    ideal = qrels.where("relevance > 0").select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "key")).alias("rank"), F.col("relevance").alias("best"))
    ideal = ideal.withColumn("n_relevant", F.count("*").over(Window.partitionBy("query_id")))
    found = run.select("query_id", "key", "rank").join(qrels.select("query_id", "key", "relevance"), ["query_id", "key"], "left")
    found = found.withColumn("relevance", F.coalesce("relevance", F.lit(0))).withColumn("seen", F.sum((F.col("relevance") > 0).cast("int")).over(by_rank))
    both = found.join(ideal, ["query_id", "rank"], "full")
    both = both.withColumn("n_relevant", F.max("n_relevant").over(Window.partitionBy("query_id"))).where("n_relevant is not null").fillna(0, ["relevance", "best"])
    each = both.groupBy("query_id").agg(*[_value(m).alias(f"m{i}") for i, m in enumerate(metrics)])
    mean = each.agg(*[F.coalesce(F.avg(f"m{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(len(metrics))])
    return mean.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("value")) for i, m in enumerate(metrics)])))
