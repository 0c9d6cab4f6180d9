"""Reusable DataFrame operators: pairing, aggregation, ranking, events, reshape, filters."""
