"""Persisted indexes, embeddings and checkpoints: tables as Parquet clustered by key, parameters as JSON beside them."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write_json(spark: SparkSession, params: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).agg(F.first("value")).head()[0])


def _clustered(rows: DataFrame, by: str, partitions: int | None) -> DataFrame:
    dealt = rows.repartitionByRange(partitions, by) if partitions else rows.repartitionByRange(by)
    return dealt.sortWithinPartitions(by)


def save_index(postings: DataFrame, path: str, params: dict | None = None, partitions: int | None = None) -> None:
    """Write (key, term, weight) so that a term's postings lie together and files can be pruned by term."""
    _clustered(postings, "term", partitions).write.mode("overwrite").parquet(f"{path}/postings")
    _write_json(postings.sparkSession, params or {}, f"{path}/params")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/postings"), _read_json(spark, f"{path}/params")


def save_embeddings(vectors: DataFrame, path: str, key: str = "key", partitions: int | None = None) -> None:
    """Write encoded texts (``key`` and what an encoder made) so that files can be pruned by key."""
    _clustered(vectors, key, partitions).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_checkpoint(spark: SparkSession, path: str, weights: dict[str, np.ndarray], params: dict | None = None) -> None:
    """Write a model's arrays, a row each, and its parameters."""
    rows = [(name, list(a.shape), a.astype("<f8").tobytes()) for name, a in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<long>, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    _write_json(spark, params or {}, f"{path}/params")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays and parameters; a model's arrays fit the driver, which hands them to each worker."""
    rows = spark.read.parquet(f"{path}/weights").collect()
    return {r.name: np.frombuffer(r.data, "<f8").reshape(r.shape) for r in rows}, _read_json(spark, f"{path}/params")
