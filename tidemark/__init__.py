"""Tidemark: feature, forecasting and scoring jobs on Spark tables."""
