"""Longitudinal web-panel analytics on Spark: DataFrame in, DataFrame out."""
