"""Spark jobs for knowledge-graph curation, graph retrieval and ledgers."""
