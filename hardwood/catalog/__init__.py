"""Named queries with their independent SQL checks."""

from hardwood.catalog.registry import oracle_texts, query_table

__all__ = ["oracle_texts", "query_table"]
