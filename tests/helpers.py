"""Helpers of the tests; not in conftest.py, of which each test folder has its own."""

from __future__ import annotations


def rows(df) -> list[tuple]:
    """Rows as tuples, sorted."""
    return sorted((tuple(row) for row in df.collect()), key=repr)
