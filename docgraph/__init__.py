"""Corpus-scale structuring, retrieval, graph QA, regulatory diffing and governance on Spark."""
