"""Siltstone: cryptographic-asset discovery and migration analytics as Spark DataFrames."""
