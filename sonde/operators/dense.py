"""Dense scoring: late interaction over all documents or over candidates, and scores of shared activated tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.functions.vectors import dot, matrices, max_sim
from sonde.operators.sparse import products, scored_sides, top_k
from sonde.sources.staging import new_path

#: Queries in a block: the bound of what a task holds of them at a time.
QUERY_BLOCK = 256


def query_blocks(queries: DataFrame) -> list[str]:
    """Write the queries' matrices to the shared folder, in files of at most QUERY_BLOCK queries; returns the files.

    Only the names come to the driver, one for QUERY_BLOCK queries.
    """
    rows = matrices(queries.withColumnRenamed("key", "query_id"), "query_id").select("query_id", "matrix")
    folder = new_path(rows.sparkSession, "queries")
    rows.write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(folder)
    files = sorted(rows.sparkSession.read.parquet(folder).inputFiles())
    return [f.replace("file:///", "/") if f.startswith("file:///") else f for f in files]


def read_block(path: str) -> list[tuple[int, np.ndarray]]:
    store, at = (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)
    table = pq.read_table(at, filesystem=store)
    return [(q, np.array(m, np.float64)) for q, m in zip(table.column("query_id").to_pylist(), table.column("matrix").to_pylist(), strict=True)]


def max_sim_all(documents: DataFrame, queries: DataFrame, k: int | None = None, floor_zero: bool = False) -> DataFrame:
    """query_id, rank, key, similarity of (key, pos, embedding) documents: every query against every document, in one pass over these.

    Each task reads the blocks of queries one by one for each of its batches. A query's best k of a batch leave it only, so
    what is shuffled is k rows a batch and query.
    """
    blocks = query_blocks(queries)

    def run(batches):
        for b in batches:
            ms = [np.array([list(r) for r in m], np.float64) for m in b["matrix"]]
            if not ms:
                continue
            joined, starts = np.concatenate(ms), np.cumsum([0, *map(len, ms)])[:-1]
            keys = b["key"].to_numpy()
            for path in blocks:
                found = []
                for q, m in read_block(path):
                    best = np.maximum.reduceat(m @ joined.T, starts, axis=1)
                    score = (np.maximum(best, 0) if floor_zero else best).sum(0)
                    take = np.lexsort((keys, -np.round(score, 9)))[: k if k is not None else len(keys)]
                    found.append(pd.DataFrame({"query_id": q, "key": keys[take], "similarity": score[take]}))
                if found:
                    yield pd.concat(found)

    return top_k(matrices(documents, "key").mapInPandas(run, "query_id long, key long, similarity double"), "key", k, positive=False)


def max_sim_pairs(documents: DataFrame, queries: DataFrame, pairs: DataFrame, floor_zero: bool = False) -> DataFrame:
    """``pairs`` (query_id, key, ...) with similarity, from (key, pos, embedding) tables of both sides."""
    q = matrices(queries.withColumnRenamed("key", "query_id"), "query_id").withColumnRenamed("matrix", "of_query")
    d = matrices(documents, "key").withColumnRenamed("matrix", "of_key")
    return pairs.drop("similarity").join(q, "query_id").join(d, "key").withColumn("similarity", max_sim(F.col("of_query"), F.col("of_key"), floor_zero)).drop("of_query", "of_key")


def max_sim_rank(documents: DataFrame, queries: DataFrame, candidates: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, rank, key, similarity and the candidates' own fields; of a query's candidates with one key, one."""
    return top_k(max_sim_pairs(documents, queries, candidates.drop("rank").dropDuplicates(["query_id", "key"])), "key", k, positive=False)


def max_sim_triplet_scores(tokens: DataFrame, triplets: DataFrame, in_batch_negatives: bool = False) -> DataFrame:
    """row, positive, negative: late interaction of anchors with either side; with in_batch the positive of the row before, too."""

    def score(pairs):
        named = pairs.select("pair", F.col("left").alias("query_id"), F.col("right").alias("key"))
        return max_sim_pairs(tokens, tokens, named).select("pair", F.col("similarity").alias("score"))

    return scored_sides(score, triplets, in_batch_negatives)


def token_triplet_scores(tokens: DataFrame, triplets: DataFrame, how: str = "sum") -> DataFrame:
    """row, positive, negative: shared tokens' products, as a sum, or as a mean over tokens and vector places.

    Triplets without a shared token on both sides are left out.
    """

    def score(pairs):
        q = tokens.select(F.col("key").alias("left"), "token", F.col("embedding").alias("q"))
        d = tokens.select(F.col("key").alias("right"), "token", F.col("embedding").alias("d"))
        hit = pairs.join(q, "left").join(d, ["right", "token"]).select("pair", dot(F.col("q"), F.col("d")).alias("product"), F.size("q").alias("dim"))
        return hit.groupBy("pair").agg((F.avg(F.col("product") / F.col("dim")) if how == "mean" else F.sum("product")).alias("score"))

    return scored_sides(score, triplets)


def shared_tokens(queries: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, key, token, product of each activated token that a query and its candidate share."""
    q = queries.select(F.col("key").alias("query_id"), "token", F.col("embedding").alias("q"))
    d = documents.select("key", "token", F.col("embedding").alias("d"))
    return candidates.select("query_id", "key").join(q, "query_id").join(d, ["key", "token"]).select("query_id", "key", "token", dot(F.col("q"), F.col("d")).alias("product"))


def shared_token_scores(queries: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, key, similarity: the products of shared tokens, summed; 0 where none is shared."""
    hit = shared_tokens(queries, documents, candidates).groupBy("query_id", "key").agg(F.sum("product").alias("similarity"))
    return candidates.select("query_id", "key").distinct().join(hit, ["query_id", "key"], "left").select("query_id", "key", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def activated_search(sparse_queries: DataFrame, sparse_documents: DataFrame, queries: DataFrame, documents: DataFrame, k: int | None = None) -> DataFrame:
    """All documents with a sparse product other than 0, by their shared tokens' score."""
    hits = products(
        sparse_queries.select(F.col("key").alias("query_id"), "term", F.col("value").alias("weight")), sparse_documents.select("key", "term", F.col("value").alias("weight")), "key"
    ).where("similarity <> 0")
    return top_k(shared_token_scores(queries, documents, hits), "key", k, positive=False)


def activated_rank(queries: DataFrame, documents: DataFrame, candidates: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, rank, key, similarity of the candidates by their shared tokens' score."""
    return top_k(shared_token_scores(queries, documents, candidates), "key", k, positive=False)


def attention_pool(logits: DataFrame, hidden: DataFrame, activated: DataFrame) -> DataFrame:
    """key, term, dim, value: for each activated term, the hidden vectors weighted by the softmax over a position's activated terms, then relu.

    logits: key, pos, term, value; hidden: key, pos, dim, value; activated: key, term.
    """
    e = logits.join(activated, ["key", "term"]).withColumn("e", F.exp("value"))
    total = e.groupBy("key", "pos").agg(F.sum("e").alias("total"))
    weight = e.join(total, ["key", "pos"]).select("key", "pos", "term", (F.col("e") / F.col("total")).alias("w"))
    mixed = weight.join(hidden, ["key", "pos"]).groupBy("key", "term", "dim").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return mixed.withColumn("value", F.greatest("value", F.lit(0.0)))

