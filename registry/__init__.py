"""Registered queries, their DuckDB counterparts, and the input views both read."""
