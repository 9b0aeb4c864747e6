"""Incremental aggregates."""
