"""Candidates, deduplication and index upkeep."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_contents(candidates: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The documents of the distinct candidate keys."""
    return documents.join(candidates.select(key).distinct(), key, "left_semi")


def unknown_candidates(candidates: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Candidate keys without a document: a caller raises if there are any."""
    return candidates.select(key).distinct().join(documents, key, "left_anti")


def first_of(rows: DataFrame, by: str | list[str], order: list[Column]) -> DataFrame:
    """One row for each ``by``, the first in ``order``."""
    columns = [by] if isinstance(by, str) else by
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*columns).orderBy(*order))).where("_at = 1").drop("_at")


def flatten_candidates(nested: DataFrame, key: str) -> DataFrame:
    """query_id, documents (array of struct with ``key``) as rows, each key once: its first by query and place."""
    rows = nested.select("query_id", F.posexplode("documents").alias("place", "document")).select("query_id", "place", "document.*")
    return first_of(rows, key, [F.col("query_id"), F.col("place")])


def add_if_absent(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return index.unionByName(new.join(index.select(key), key, "left_anti"))


def append(index: DataFrame, new: DataFrame) -> DataFrame:
    return index.unionByName(new)


def fan_out(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Results by query text for every row of ``queries`` (query_id, query), duplicates too."""
    return queries.join(results, "query")


def distinct_queries(queries: DataFrame, order: list[Column] | None = None, warn: bool = False) -> DataFrame:
    """One row a query text, of duplicates the last by ``order`` (query_id); ``warn`` counts them first and tells."""
    if warn:
        n, distinct = queries.agg(F.count("*"), F.count_distinct("query")).head()
        if distinct < n:
            warnings.warn(f"{n - distinct} duplicate queries: each text is answered once", stacklevel=2)
    return first_of(queries, "query", order or [F.col("query_id").desc()])


def distinct_contents(documents: DataFrame, key: str, content: Column) -> DataFrame:
    """content, key, n: each distinct content, the least key that has it, and how many do."""
    return documents.select(F.col(key), content.alias("content")).groupBy("content").agg(F.min(key).alias(key), F.count("*").alias("n"))
