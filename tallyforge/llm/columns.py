"""Working names for the columns of any input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, …, and the working names of the given ones.

    Whatever an input calls its columns, none clashes with an operator's own;
    ``toDF(*df.columns)`` gives the names back.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]
