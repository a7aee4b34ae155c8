"""Plug-in points: matchers, embedders and named reports."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Matcher = Callable[[DataFrame, DataFrame], DataFrame]
_matchers: dict[str, Matcher] = {}
_embedders: dict[str, Callable[[pd.Series], pd.Series]] = {}
_reports: dict[str, Callable[..., DataFrame]] = {}


def register_matcher(name: str, matcher: Matcher) -> None:
    """A function of two tables that returns (key, target) or (key, target, score)."""
    _matchers[name] = matcher


def match(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    return _matchers[name](left, right)


def register_embedder(name: str, embedder: Callable[[pd.Series], pd.Series]) -> None:
    """A function from a batch of texts to a batch of vectors."""
    _embedders[name] = embedder


def embed(name: str, texts: DataFrame) -> DataFrame:
    """(document_id, embedding) by a registered embedder, in Arrow batches."""
    function = _embedders[name]

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return function(batch.fillna(""))

    return texts.select("document_id", run("text").alias("embedding"))


def register_report(name: str, report: Callable[..., DataFrame]) -> None:
    _reports[name] = report


def run_report(name: str, *tables: DataFrame, view: str | None = None, **options) -> DataFrame:
    """Run a report by name; with ``view`` its result is also a temporary view for SQL."""
    out = _reports[name](*tables, **options)
    if view is not None:
        out.createOrReplaceTempView(view)
    return out


def reports() -> list[str]:
    return sorted(_reports)
