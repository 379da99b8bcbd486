"""Structured Streaming forms: feeds, presence, metrics, incremental supersession, leases."""
