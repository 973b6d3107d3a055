"""Evaluation tables, scores and reports for language models, as Spark jobs."""
