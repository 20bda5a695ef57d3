"""Sluice: a fluent layer over Spark DataFrames for typed file streams, ordered operators and case routing."""

__all__ = ["flow", "session"]
