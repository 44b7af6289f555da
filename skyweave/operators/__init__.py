"""Relational, graph, spatial and numeric operators over DataFrames."""
