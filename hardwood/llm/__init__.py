"""Operators of a training-data pipeline over `documents`, their queries and their SQL checks."""

from hardwood.llm.catalog import oracle_texts, query_table

__all__ = ["oracle_texts", "query_table"]
