"""Structured Streaming and incremental versions of the batch jobs."""
