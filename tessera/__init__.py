"""Tessera: graph-shaped analytics over documents, clauses and extracted restrictions, on Spark DataFrames."""
