"""Retrieval, snapshot, symbol-graph and job analytics over text corpora, on PySpark."""
