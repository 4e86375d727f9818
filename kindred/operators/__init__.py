"""Joins, candidate pairs, clusters, graphs, evaluation and typed tokens over DataFrames."""
