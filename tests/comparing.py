"""Rows of Spark and DuckDB in one comparable form."""

from __future__ import annotations


def plain(value):
    """A value in a form that both engines share."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows(names, data):
    """Rows as a sorted list, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)
