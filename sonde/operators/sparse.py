"""Sparse vectors in long form (key, term, value): products, top-k, pooling, and the scores used in training."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared by this many digits, so that equal documents tie whatever the order of summation.
DIGITS = 9


def top_k(scores: DataFrame, key: str, k: int | None, positive: bool = True) -> DataFrame:
    """query_id, rank, key, similarity and further columns: the k best keys of each query; ties go by key."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", DIGITS)), key)
    ranked = scores.withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    if positive:
        ranked = ranked.where(F.round("similarity", DIGITS) > 0)
    return ranked.select("query_id", "rank", key, "similarity", *[c for c in scores.columns if c not in ("query_id", key, "similarity")])


def products(queries: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """query_id, key, similarity: the dot product of each query with each key that shares a term with it."""
    q = queries.select("query_id", "term", F.col("weight").alias("asked"))
    return q.join(index.select(key, "term", "weight"), "term").groupBy("query_id", key).agg(F.sum(F.col("asked") * F.col("weight")).alias("similarity"))


def search(queries: DataFrame, index: DataFrame, key: str, k: int | None = None) -> DataFrame:
    return top_k(products(queries, index, key), key, k)


def pool(logits: DataFrame, key: str) -> DataFrame:
    """key, term, value: the largest ln(1 + max(0, logit)) of each term over the positions of a text."""
    return logits.groupBy(key, "term").agg(F.max(F.log1p(F.greatest(F.col("value"), F.lit(0.0)))).alias("value"))


def strongest(activations: DataFrame, key: str, k: int, nonzero: bool = False) -> DataFrame:
    """The k largest entries of each key, also where they are 0, unless ``nonzero``."""
    order = Window.partitionBy(key).orderBy(F.desc("value"), "term")
    kept = activations.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).drop("pos")
    return kept.where("value <> 0") if nonzero else kept


def pair_products(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, score of (pair, left, right): the dot product of the two keys' vectors, 0 where no term is shared."""
    a = left.select(F.col("key").alias("left"), "term", F.col("value").alias("x"))
    b = right.select(F.col("key").alias("right"), "term", F.col("value").alias("y"))
    hit = pairs.join(a, "left").join(b, ["right", "term"]).groupBy("pair").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    return pairs.select("pair").join(hit, "pair", "left").select("pair", F.coalesce("score", F.lit(0.0)).alias("score"))


def triplet_scores(activations: DataFrame, triplets: DataFrame, in_batch_negatives: bool = False) -> DataFrame:
    """row, positive, negative of (row, anchor, positive, negative): dot products; with in_batch the positive of the row before, too."""
    return scored_sides(lambda pairs: pair_products(activations, activations, pairs), triplets, in_batch_negatives)


def scored_sides(score: Callable[[DataFrame], DataFrame], triplets: DataFrame, in_batch_negatives: bool = False) -> DataFrame:
    """row and a score for each side of the triplets; ``score`` takes (pair, left, right) to (pair, score). Rows without a score go."""
    sides = {c: triplets.select(F.col("row").alias("pair"), F.col("anchor").alias("left"), F.col(c).alias("right")) for c in ("positive", "negative")}
    if in_batch_negatives:
        sides["in_batch"] = in_batch(triplets.select("row", "anchor", "positive")).select(F.col("row").alias("pair"), F.col("anchor").alias("left"), F.col("rolled").alias("right"))
    each = [score(pairs).select(F.col("pair").alias("row"), F.col("score").alias(c)) for c, pairs in sides.items()]
    return reduce(lambda x, y: x.join(y, "row"), each)


def in_batch(pairs: DataFrame) -> DataFrame:
    """(row, anchor, positive) with each row's positive of the row before, the first row's of the last."""
    n = pairs.agg(F.count("*").alias("n"))
    moved = pairs.join(F.broadcast(n)).select(F.expr("pmod(row + 1, n)").alias("row"), F.col("positive").alias("rolled"))
    return pairs.join(moved, "row")


def in_batch_products(vectors: DataFrame) -> DataFrame:
    """key, score: each vector's dot product with the sum of all others, by way of the sums per term."""
    total = vectors.groupBy("term").agg(F.sum("value").alias("total"))
    return vectors.join(total, "term").groupBy("key").agg(F.sum(F.col("value") * (F.col("total") - F.col("value"))).alias("score"))
