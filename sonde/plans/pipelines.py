"""Retrieve, then re-rank."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sonde.operators.dense import max_sim_rank
from sonde.operators.rank import candidate_contents


def retrieve_and_rank(candidates: DataFrame, document_vectors: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank, key, similarity: first-stage candidates (query_id, key, ...) re-ranked by late interaction."""
    needed = candidate_contents(candidates, document_vectors, "key")
    return max_sim_rank(needed, query_vectors, candidates, k)
