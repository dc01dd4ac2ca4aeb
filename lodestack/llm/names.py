"""Names for helper columns that can't clash with a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, base: str) -> str:
    """``base``, with underscores until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base
