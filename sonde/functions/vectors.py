"""Vector functions on arrays, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def max_sim(query: Column, document: Column, floor_zero: bool = False) -> Column:
    """Late interaction of two arrays of vectors: for each query vector its best document vector, summed."""
    best = lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))
    kept = (lambda q: F.greatest(best(q), F.lit(0.0))) if floor_zero else best
    return F.aggregate(F.transform(query, kept), F.lit(0.0), lambda s, x: s + x)


def matrices(tokens: DataFrame, key: str) -> DataFrame:
    """key, matrix (array of vectors by pos) of a long table (key, pos, embedding)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "embedding")))
    return tokens.groupBy(key).agg(F.transform(rows, lambda x: x["embedding"]).alias("matrix"))
