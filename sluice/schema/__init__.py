"""Binding of columns to a schema."""
