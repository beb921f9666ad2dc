"""Operators for training-data pipelines. Nothing outside this subpackage imports it, except the entry module's guard."""
