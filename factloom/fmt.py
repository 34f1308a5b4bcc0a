"""Markdown tables of results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame


def cell(value: object) -> str:
    if value is None:
        return "nil"
    if isinstance(value, float):
        return f"{value:.2f}"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A table of up to `limit` rows and their number."""
    rows = df.limit(limit + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:limit]]
    return "\n".join(lines) + f"\n\n_{min(len(rows), limit)}{'+' if len(rows) > limit else ''} rows_\n"
