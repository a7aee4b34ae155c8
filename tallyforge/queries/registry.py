"""Query registry: name -> function of (spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Canonical views and tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def edge(df: DataFrame) -> DataFrame:
    """Money is decimal up to the output, where it becomes double."""
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema if isinstance(f.dataType, DecimalType)})


def query(*views: str, sql: str | None = None) -> Callable:
    """Register a function of Views under its name; ``sql`` follows the WITH clause of ``views``."""

    def add(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: edge(f(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[f.__name__] = (with_views(*views) if views else "") + sql.strip()
        return f

    return add
