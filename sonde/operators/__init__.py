"""Search, ranking, losses and evaluation as DataFrame operators."""
