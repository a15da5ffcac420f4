"""Structured Streaming forms of the enrichment and the minute roll-up."""
