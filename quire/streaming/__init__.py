"""Structured Streaming variants of the ingest and scoring operators."""
