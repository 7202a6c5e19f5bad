"""An index kept up to date by a stream: each micro-batch is one ``add``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sonde.operators.lexical import BM25, Lexical


def index_stream(stream: DataFrame, index: Lexical, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's keys and normalised texts to ``folder``, by batch; ``load`` makes the index from them.

    The texts are a fraction of their n-grams' counts, which searches make of the queries' terms alone.

    A micro-batch that runs again overwrites its own part. No batch needs another one's texts.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        index.rows(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, index: BM25, folder: str) -> BM25:
    """``index`` with a batch for each micro-batch in ``folder``, in their order; empty ones are left out."""
    rows = spark.read.parquet(f"{folder}/rows")
    for batch in sorted(r.batch for r in rows.select("batch").distinct().collect()):  # one row a micro-batch
        index = index.add_rows(rows.where(F.col("batch") == batch).drop("batch"))
    return index


def stream_table(spark: SparkSession, schema, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
