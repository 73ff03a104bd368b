"""Spark jobs for market panels, and (in ``llm``) for training-data pipelines."""
