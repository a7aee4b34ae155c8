"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows (``most_rows``, chosen by a hash
of the id): presence counts of hashed character n-grams give the log-count ratio
r of each feature; the features of largest |r| enter a logistic regression whose
inputs are presence times r. Scoring maps over all whole texts with the fitted
weights and shuffles nothing.

Only the text enters a score. Defined results: a null or empty text scores the
model's intercept; repeated rows give repeated results; very long texts are read whole;
an empty table gives an empty one; without labels of both
classes every score is the prior (0 without any label); rows of ``labels`` with
a null id or label are left out; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .words import blocks, mix, raw

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Bytes of text worked on at once: an n-gram takes about 50 bytes while it is counted.
BLOCK = 1 << 20
#: Fixed seed of the features' hash.
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    """weights[i] belongs to the i-th of the sorted ``features`` (hash buckets)."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each n-gram of lower-cased bytes; none crosses a text's end."""
    if len(data) < order:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = data.astype(np.uint64)
    low[(data >= 65) & (data <= 90)] += np.uint64(32)
    low[data < 0x21] = 32
    top = len(data) - order + 1
    code = np.full(top, order, dtype=np.uint64)
    for j in range(order):
        code = code * np.uint64(257) + low[j : j + top]
    bucket = ((code * _STEP) >> np.uint64(64 - BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:top]
    keep = np.arange(top) + order <= offsets[1:][text]
    return text[keep], bucket[keep]


def presence(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order, the distinct (text number, bucket) pairs, or (text number, index in ``known``) of the known buckets alone."""
    data, offsets = raw(column)
    lookup = None
    if known is not None:
        lookup = np.full(1 << BITS, -1, dtype=np.int32)
        lookup[known] = np.arange(len(known))
    for order in ORDERS:
        text, bucket = ngram_buckets(data, offsets, order)
        if lookup is not None:
            found = lookup[bucket]
            hit = found >= 0
            text, bucket = text[hit], found[hit].astype(np.int64)
        pairs = np.unique(text << BITS | bucket)
        yield pairs >> BITS, pairs & ((1 << BITS) - 1)


def features_of(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, index in ``known``) over all orders, by text."""
    parts = list(presence(column, known))
    text, index = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(text, kind="stable")
    return text[order], index[order]


def _labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int, scratch: Scratch) -> DataFrame:
    picked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("id is not null and y is not null")
    picked = picked.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # At most most_rows rows of two numbers are broadcast; the sampled texts are then dealt out evenly.
    return scratch.keep(texts.join(F.broadcast(picked), "id").repartition(16), "sample")


def _counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int32)
        rows = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                y = block.column(1).to_numpy(zero_copy_only=False)
                for text, bucket in presence(block.column(0)):
                    for c in (0, 1):
                        total[c] += np.bincount(bucket[y[text] == c], minlength=1 << BITS).astype(np.int32)
                rows += [int((y == 0).sum()), int((y == 1).sum())]
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[0][some], rows[0]), pa.int64()), pa.array(np.append(total[1][some], rows[1]), pa.int64())], names=["bucket", "n0", "n1"])

    return sample.select("text", "y").mapInArrow(count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = 20_000,
    n_features: int = 4096,
    least_texts: int = 5,
    rounds: int = 200,
    ridge: float = 1e-4,
) -> Model:
    """Fit on at most ``most_rows`` labelled rows; their sparse features (bounded by that number) are fitted on the driver."""
    scratch = Scratch(docs.sparkSession)
    sample = _labelled_sample(docs, labels, id_col, text_col, label_col, most_rows, scratch)
    counts = scratch.keep(_counts(sample), "counts")
    size = counts.filter("bucket = -1").first()
    n0, n1 = (size["n0"], size["n1"]) if size else (0, 0)
    none = np.zeros(0, dtype=np.int64)
    if not n0 or not n1:
        scratch.drop("sample", "counts")
        return Model(none, none.astype(float), 30.0 if n1 else -30.0)
    ratio = F.log((F.col("n1") + 1) / F.lit(float(n1 + 2))) - F.log((F.col("n0") + 1) / F.lit(float(n0 + 2)))
    # Strength: how far the ratio is from 0, weighed by how surely it is known.
    strength = F.abs(F.col("r")) * F.sqrt(F.least("n1", "n0") + F.greatest("n1", "n0") / 8)
    chosen = counts.filter(f"bucket >= 0 and n0 + n1 >= {least_texts}").select("bucket", "n0", "n1", ratio.alias("r")).orderBy(strength.desc(), "bucket").limit(n_features).toPandas().sort_values("bucket")
    features, r = chosen["bucket"].to_numpy(np.int64), chosen["r"].to_numpy(float)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                text, index = features_of(block.column(0), features)
                at = np.searchsorted(text, np.arange(block.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([block.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(index, pa.int32()))], names=["y", "index"])

    rows = sample.select("text", "y").mapInArrow(encode, "y int, index array<int>").toPandas()
    scratch.drop("sample", "counts")
    y = (rows["y"].to_numpy() > 0).astype(float)
    sizes = rows["index"].map(len).to_numpy()
    column = np.concatenate([*rows["index"], np.zeros(0, dtype=np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(y)), sizes)
    return Model(features, *_logistic(row, column, r, y, len(features), rounds, ridge))


def _logistic(row: np.ndarray, column: np.ndarray, r: np.ndarray, y: np.ndarray, width: int, rounds: int, ridge: float) -> tuple[np.ndarray, float]:
    """Logistic regression on presence x r by accelerated full gradients; returns weights with r multiplied in."""
    n = len(y)
    value = r[column]
    scale = np.bincount(row, weights=value * value, minlength=n).max(initial=1.0)
    rate = 4.0 / (scale + 1.0)
    w, b = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    pw, pb = w, b
    ahead_w, ahead_b = w, b
    curve = np.maximum(np.bincount(column, weights=value * value, minlength=width) / n, 1e-4)
    step = 4.0 / (np.sqrt(curve) * np.sqrt(curve).sum() * 1.0 + 1e-9) if width else curve
    step = np.minimum(np.maximum(step, rate), 50.0)
    for k in range(rounds):
        z = np.bincount(row, weights=value * ahead_w[column], minlength=n) + ahead_b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        pw, pb = w, b
        w = ahead_w - step * (np.bincount(column, weights=value * g[row], minlength=width) / n + ridge * ahead_w)
        b = ahead_b - 1.0 * g.mean()
        m = k / (k + 3)
        ahead_w, ahead_b = w + m * (w - pw), b + m * (b - pb)
    return w * r, b


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) for every row; a map without a shuffle."""
    features, weights, intercept = model

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                text, index = features_of(block.column(1), features)
                z = np.bincount(text, weights=weights[index], minlength=block.num_rows) + intercept
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(rate, f"`{id_col}` {picked.schema['id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under the threshold; null texts stay if the empty text would."""
    features, weights, intercept = model
    place = docs.columns.index(text_col)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), f"c{place}", BLOCK):
                text, index = features_of(block.column(place), features)
                z = np.bincount(text, weights=weights[index], minlength=block.num_rows) + intercept
                yield block.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold)).rename_columns(batch.schema.names)

    return docs.mapInArrow(sieve, docs.schema)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: crc32 of the id's text mod 4 is not 2."""
    return labels.filter(F.crc32(F.col(id_col).cast("string")) % 4 != 2)
