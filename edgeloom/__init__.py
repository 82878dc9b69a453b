"""Lineage-impact analytics on Spark DataFrames."""
