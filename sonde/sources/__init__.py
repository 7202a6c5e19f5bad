"""Corpora, judgements, training triples, batches and persisted indexes."""
