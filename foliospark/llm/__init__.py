"""Operators for large training-data pipelines, their queries and SQL counterparts."""

from foliospark.llm.queries import ORACLES, QUERIES  # noqa: F401
