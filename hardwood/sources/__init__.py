"""Scans, contracts, incremental ingest, sinks and the adapters of the generic tables."""
