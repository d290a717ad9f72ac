"""Pipelines: one per command of the audit, each a set of named result tables."""
