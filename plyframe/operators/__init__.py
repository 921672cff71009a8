"""Operators: each takes tables and returns a table; none collects data or keeps a session."""
