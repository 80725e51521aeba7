"""Column names of our own beside those of a caller's table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened where the table has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
