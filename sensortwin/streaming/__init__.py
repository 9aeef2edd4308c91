"""Structured Streaming pipeline: landing -> bronze -> silver -> incremental gold."""
