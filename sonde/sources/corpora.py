"""Corpora with judgements, training triples, batches and epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonde.functions.text import content
from sonde.sources.staging import staged


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (id, title, text), queries (query_id, query), qrels (query_id, key, relevance) of a corpus folder.

    The folder has corpus.jsonl, queries.jsonl and qrels/<split>.tsv. Queries are those the split judges; of queries with one text
    the last id stands for all.
    """
    docs = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("id"), "title", "text")
    asked = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    judged = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, key string, relevance int")
    asked = asked.join(judged.select("query_id").distinct(), "query_id", "left_semi")
    last = asked.groupBy("query").agg(F.max("query_id").alias("query_id"))
    return docs, last.select("query_id", "query"), judged.join(last, "query_id", "left_semi")


def numbered(rows: DataFrame, order: list[str], name: str, within: str | None = None) -> DataFrame:
    """``rows`` with ``name``: their place from 0 by ``order``, in all or in each group ``within``, that no task sees whole.

    Rows are dealt to ranges of the order, written once, and numbered inside a range behind the rows of the ranges before it.
    """
    first = [within] if within else []
    part, at = f"_{name}_part", f"_{name}_at"
    dealt = staged(rows.repartitionByRange(*first, *order).withColumn(part, F.spark_partition_id()), "numbered")
    here = dealt.withColumn(at, F.row_number().over(Window.partitionBy(*first, part).orderBy(*order)) - 1)
    sizes = dealt.groupBy(*first, part).agg(F.count("*").alias("_c"))  # a row a range, and a group's part of it
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*first).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return here.join(sizes, [*first, part]).withColumn(name, F.col("_before") + F.col(at)).select(*rows.columns, name)


def triples(qrels: DataFrame, queries: DataFrame, documents: DataFrame, key: str, on: str | list[str], seed: int = 0, exclude_positive: bool = False) -> DataFrame:
    """query_id, key, anchor, positive, negative_key, negative: for each relevant pair a document picked by arithmetic from all.

    ``documents`` are numbered by key; the pick is (query_id * 7919 + number of the positive + seed) mod n, or the next if it is excluded.
    """
    n = documents.agg(F.count("*").alias("n"))
    numbers = numbered(documents.select(F.col(key).alias("key"), content(on).alias("content")), ["key"], "number")
    pairs = qrels.where("relevance > 0").join(queries, "query_id").join(numbers, "key").join(F.broadcast(n))
    pick = F.pmod(F.col("query_id") * 7919 + F.col("number") + seed, F.col("n"))
    if exclude_positive:
        pick = F.when(pick == F.col("number"), F.pmod(pick + 1, F.col("n"))).otherwise(pick)
    picked = pairs.select("query_id", "key", F.col("query").alias("anchor"), F.col("content").alias("positive"), pick.alias("number"))
    other = numbers.select("number", F.col("key").alias("negative_key"), F.col("content").alias("negative"))
    return picked.join(other, "number").drop("number")


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with batch: consecutive runs of ``size`` rows by ``order``."""
    return numbered(rows, order, "batch").withColumn("batch", F.floor(F.col("batch") / size))


def epochs(rows: DataFrame, key: str, n_epochs: int, size: int, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """The rows with epoch and batch, each epoch in an order of its own (``shuffle``) or by key."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n_epochs))))
    place = F.pmod((F.col(key) + seed) * (2 * F.col("epoch") + 7919), F.lit(1_000_003)) if shuffle else F.lit(0)
    return numbered(each.withColumn("_place", place), ["_place", key], "batch", "epoch").drop("_place").withColumn("batch", F.floor(F.col("batch") / size))
