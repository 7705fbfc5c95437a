"""Columnar analytics on Spark: a lazy table API whose operators compile to DataFrame plans."""
