"""Incremental forms of batch jobs."""
