"""Line dedup by site-relative frequency.

A line's frequency at a host is the number of that host's pages that contain it,
divided by the host's pages. Lines over a boilerplate ratio are dropped from
that host's texts.

Pages are counted per (host, line) after each page's repeats are folded, with
partial sums before the shuffle, so a hot host or line costs each task one row.
The lines to drop are at most (mean lines per page / ratio) per host. They travel
to the texts by host: broadcast when the whole list is counted and small, else in
a join whose hot hosts Spark may split.

Defined results: a null text stays null and has no lines, but counts as a page;
null hosts form one host; repeated rows are pages of their own; lines without a
word are never dropped; very long texts are read whole; an empty table gives an empty one;
all input columns return unchanged but the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import numbered
from ..scratch import Scratch

#: Up to so many lines to drop (two numbers each) are broadcast.
MOST_BROADCAST = 200_000

_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """96 bits of the line, as a string-free pair."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", percent: int = 10, least_pages: int = 3) -> DataFrame:
    """(host, key, pages, host_pages) of the lines over the ratio: 100 * pages > percent * host_pages, on ``least_pages`` pages or more."""
    picked = docs.select(F.struct(docs[host_col].alias("v")).alias("host"), docs[text_col].cast("string").alias("text"))
    totals = picked.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    own = F.array_distinct(F.filter(_lines(F.col("text")), lambda x: x.rlike(_WORD)))
    counted = picked.select("host", F.explode(F.transform(own, _key)).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    return counted.join(F.broadcast(totals) if totals.count() <= MOST_BROADCAST else totals, "host").filter(F.col("pages") * 100 > F.col("host_pages") * percent)


def line_dedup(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", percent: int = 10, least_pages: int = 3, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines dropped; with ``counts`` also n_lines and n_dropped."""
    scratch = Scratch(docs.sparkSession)
    work, (host, text) = numbered(docs, host_col, text_col)
    found = scratch.keep(boilerplate_lines(work, host_col=host, text_col=text, percent=percent, least_pages=least_pages), "boilerplate")
    per_host = found.groupBy("host").agg(F.collect_list("key").alias("_drop")).withColumnRenamed("host", "_host")
    if found.count() <= MOST_BROADCAST:
        per_host = F.broadcast(per_host)
    joined = work.withColumn("_at", F.struct(F.col(host).alias("v"))).join(per_host, F.col("_at") == F.col("_host"), "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_drop"), _key(x)))
    cleaned = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text else F.col(c) for c in work.columns]
    names = list(docs.columns)
    if counts:
        n = F.coalesce(F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)), F.lit(0)).cast("long")
        left = F.when(F.col("_drop").isNull() | F.col(text).isNull(), n).otherwise(F.size(kept)).cast("long")
        columns += [n.alias("n_lines"), (n - left).alias("n_dropped")]
        names += ["n_lines", "n_dropped"]
    return joined.select(*columns).toDF(*names)
