"""Retrieve, re-rank, evaluate: composed plans and the query registry."""
