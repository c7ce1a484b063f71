"""Lineage graphs, catalogue search and feature tables as Spark jobs."""
