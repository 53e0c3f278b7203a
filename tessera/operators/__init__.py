"""Operators over the graph's tables; each takes and returns DataFrames."""
