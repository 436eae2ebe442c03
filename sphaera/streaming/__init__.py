"""Structured Streaming around incremental tessellations."""
