"""Training-data operators: tokenisation, deduplication, filtering and search over large corpora."""
