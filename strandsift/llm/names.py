"""Names for helper columns that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with as many underscores in front as keep them apart from the columns of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = "_" + name
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
