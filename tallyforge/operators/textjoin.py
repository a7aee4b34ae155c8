"""Joins of texts that hold one another or are a few edits apart, without comparing all pairs.

Both meet on keys that every matching pair must share, and on the rarest of them:
frequencies are counted first, so a beginning that all names have in common draws no
pairs together.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..scratch import shuffled

#: Characters of the grams on which a text meets what holds it: the most that it has. Twice the one before,
#: so that a long text, one number among millions for instance, meets few that do not hold it.
GRAMS = (1, 2, 3, 6, 12, 24)
#: Bytes of needles that are broadcast at most, ROW_BYTES for each row besides its text; beyond, both sides are shuffled by gram.
MOST_BYTES, ROW_BYTES = 32 << 20, 100
#: Segments beyond those that edits can spoil: so many of the most frequent ones are left out.
SPARE = 2


def _grams(text: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters; none where the text is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def contained(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """(needle, hay): every pair of distinct texts, not empty, of which ``hay`` holds ``needle``.

    A needle meets the texts that hold the rarest of its grams of the longest of GRAMS
    that it has. Needles of a checked size are broadcast, so long texts stay
    where they are; more of them are shuffled by gram.
    """
    own = needles.filter(F.length(needle) > 0).select(F.col(needle).alias("needle")).distinct()
    held = hays.filter(F.length(hay) > 0).select(F.col(hay).alias("hay")).distinct()
    size = F.lit(GRAMS[0])
    for n in GRAMS[1:]:
        size = F.when(F.length("needle") >= n, n).otherwise(size)
    # A number and a sum for each of GRAMS come back at most.
    known = own.groupBy(size.alias("size")).agg(F.sum(F.octet_length("needle") + ROW_BYTES).alias("bytes")).collect()
    if not known:
        return own.withColumn("hay", F.col("needle")).filter(F.lit(False))
    grams = held.withColumn("gram", F.explode(F.flatten(F.array(*[_grams(F.col("hay"), F.lit(r["size"])) for r in known]))))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    met = own.withColumn("gram", F.explode(_grams(F.col("needle"), size))).join(shuffled(counts), "gram", "left")
    rarest = met.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).filter("m.n > 0").select("needle", F.col("m.gram").alias("gram"))
    small = sum(r["bytes"] for r in known) <= MOST_BYTES
    return grams.join(F.broadcast(rarest) if small else shuffled(rarest), "gram").filter(F.contains("hay", "needle")).select("needle", "hay")


def contained_targets(keys: DataFrame, text: str, names: DataFrame, name: str, *, name_in_text: bool = True, text_in_name: bool = True) -> DataFrame:
    """(key, target) where a key's text holds a name or a name holds it; of equal names the smallest and the greatest target, which tell whether one is alone."""
    ends = names.filter(F.length(name) > 0).groupBy(F.col(name).alias("_name")).agg(F.array(F.min("target"), F.max("target")).alias("_targets"))
    pairs = []
    if name_in_text:
        pairs.append(contained(ends, "_name", keys, text).select(F.col("hay").alias("_text"), F.col("needle").alias("_name")))
    if text_in_name:
        pairs.append(contained(keys, text, ends, "_name").select(F.col("needle").alias("_text"), F.col("hay").alias("_name")))
    met = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])
    found = met.join(shuffled(ends), "_name").select("_text", F.explode("_targets").alias("target")).distinct()
    return keys.select("key", F.col(text).alias("_text")).join(shuffled(found), "_text").select("key", "target")


def edits(threshold: float, ratio: bool) -> tuple[Callable[[Column, Column], Column], float]:
    """The most edits that two texts of given lengths may be apart, and the least share of the longer length that the shorter has.

    By edit distance: 1 - edits / longer >= threshold. By matching ratio 2 M / (a + b):
    what is not matched can be edited away, so edits <= (1 - threshold) (a + b).
    """
    slack = 1 - threshold + 1e-9
    if ratio:
        return lambda a, b: F.floor((a + b) * slack).cast("int"), threshold / (2 - threshold)
    return lambda a, b: F.floor(F.greatest(a, b) * slack).cast("int"), threshold


def _segments(rows: DataFrame) -> DataFrame:
    """Rows (size, k) with each segment i of a text of ``size``: its start from 0 and length. One more than k, and SPARE ones where the text is long enough."""
    parts = F.greatest(F.lit(1), F.least(F.col("k") + 1 + SPARE, F.col("size")))
    rows = rows.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    base, longer = F.floor(F.col("size") / F.col("parts")).cast("int"), F.col("size") % F.col("parts")
    behind = F.greatest(F.lit(0), F.col("i") - (F.col("parts") - longer))
    return rows.withColumns({"start": (F.col("i") * base + behind).cast("int"), "length": (base + (F.col("i") >= F.col("parts") - longer).cast("int")).cast("int")})


def near_texts(left: DataFrame, right: DataFrame, *, threshold: float = 0.85, ratio: bool = False) -> DataFrame:
    """(a, b): all pairs of distinct texts a of ``left`` and b of ``right`` (column ``text``) that are few enough edits apart to reach the threshold.

    Pigeonhole: of the k + 1 + SPARE segments of b, k edits spoil k at most, so SPARE + 1
    at least stand in a, each at most as far from its own place as the edits around it
    allow. b is found by its k + 1 rarest segments; the SPARE most frequent are left
    out. Every candidate is checked by a distance that stops beyond k. The threshold
    must be over 0.5 (0.67 with ``ratio``), else a text has fewer characters than edits.
    Meant for names: the places at which a text is looked up grow with the cube of its
    length (some 600 for 30 characters at 0.8), in narrow rows that go by key.
    """
    most, least_share = edits(threshold, ratio)
    if threshold <= (2 / 3 if ratio else 0.5):
        raise ValueError("the threshold is too low for segments")
    size = F.length("text")
    bounds = lambda: F.explode(F.sequence(F.ceil(size * least_share - 1e-6).cast("int"), F.floor(size / least_share + 1e-6).cast("int")))
    texts = lambda df: df.select("text").filter("text is not null").distinct()
    # b stands once for every number of edits that a partner's length allows.
    stored = texts(right).select(F.col("text").alias("b"), size.alias("size"), bounds().alias("other"))
    stored = stored.withColumn("k", most(F.col("other"), F.col("size"))).filter(F.abs(F.col("other") - F.col("size")) <= F.col("k")).select("b", "size", "k").distinct()
    keyed = _segments(stored).select("b", "size", "k", "i", F.substring("b", F.col("start") + 1, F.col("length")).alias("part"))
    key = ["size", "k", "i", "part"]
    counted = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    rare = Window.partitionBy("b", "k").orderBy("n", "i")
    kept = keyed.join(counted, key).withColumn("place", F.row_number().over(rare)).filter(F.col("place") <= F.col("k") + 1).select("b", *key)
    asked = texts(left).select(F.col("text").alias("a"), size.alias("own"), bounds().alias("size")).withColumn("k", most(F.col("own"), F.col("size")))
    gap = F.col("own") - F.col("size")
    asked = _segments(asked.filter(F.abs(gap) <= F.col("k")))
    low = F.greatest(F.lit(0), F.col("start") - F.floor((F.col("k") - gap) / 2).cast("int"))
    high = F.least(F.col("own") - F.col("length"), F.col("start") + F.floor((F.col("k") + gap) / 2).cast("int"))
    asked = asked.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    probes = asked.select("a", "size", "k", "i", F.substring("a", F.col("at") + 1, F.col("length")).alias("part")).distinct()
    pairs = probes.join(kept, key).select("a", "b", "k").distinct()
    return pairs.filter(F.expr("levenshtein(a, b, k) >= 0")).select("a", "b").distinct()


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, by longest common blocks (Ratcliff and Obershelp)."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")
