"""Registered queries over the given tables, and the same in DuckDB SQL."""

from tileframe.plans import contracts, more, queries  # noqa: F401
