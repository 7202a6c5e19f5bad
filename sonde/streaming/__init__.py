"""Index maintenance per micro-batch."""
