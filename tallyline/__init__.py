"""Explainable record linkage over semi-structured listings, on Spark DataFrames."""
