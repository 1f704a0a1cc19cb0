"""Protein homology search and sequence data processing as Spark jobs."""
