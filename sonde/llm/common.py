"""Shared plumbing of the training-data operators: input tables, worker code and memory, joins that deal out hot keys."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.sources.staging import new_path, remove, shared_dir, staged, staged_at
from sonde.sources.workers import give_back, tidied

__all__ = ["documents", "give_back", "new_path", "remove", "shared_dir", "ship", "spread_join", "staged", "staged_at", "table", "texts", "tidied"]

#: Rows per Arrow batch: texts can be long, so batches are kept short to bound a worker's memory.
BATCH_ROWS = 512
#: A key with more than this part of a table's rows is hot; so there are at most as many hot keys, which bounds their broadcast.
HOT_KEYS = 1024
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of ``documents``; a null text is an empty one."""
    return texts(table(spark, sf_dir, "documents"))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, wherever they run, and bound their Arrow batches."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="sonde-code-")) / "sonde_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def spread_join(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, by: list[str]) -> DataFrame:
    """``rows`` left-joined on ``keys`` with ``counted``: one row per key, with c, how many of the ``total`` rows have it.

    Hot keys (at most HOT_KEYS, by their count) are looked up in a broadcast. Their rows, and rows whose key has a null, are
    dealt out by ``by`` in the join of the others, so no task gets all rows of a key.
    """
    values = [c for c in counted.columns if c not in keys]
    hot = counted.where(F.col("c") > max(total // HOT_KEYS, 64)).select(*keys, F.struct(*values).alias("hot"))
    zero = F.least(F.col("c"), F.lit(0)).cast("int")  # not a literal: the optimizer would take that out of the key
    cold = counted.select(*keys, zero.alias("salt"), F.struct(*values).alias("cold"))
    alone = F.col("hot").isNotNull()
    for k in keys:
        alone = alone | F.col(k).isNull()
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(alone, 1 + F.pmod(F.xxhash64(*by), F.lit(HOT_KEYS)).cast("int")).otherwise(0))
    joined = salted.join(cold, [*keys, "salt"], "left").withColumn("found", F.coalesce("hot", "cold"))
    return joined.select(*rows.columns, *[F.col("found")[v].alias(v) for v in values])
