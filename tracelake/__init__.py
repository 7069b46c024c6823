"""Lineage-graph analytics on Spark DataFrames."""
