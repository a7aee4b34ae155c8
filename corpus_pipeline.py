"""A training corpus in five stages, from ``documents`` to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.

Defined results: an empty table passes every stage as an empty one; null and empty
texts are clean if the model's intercept says so, have no lines to drop, link with
nothing, have no tokens to weigh and are encoded as no pieces; rows with a null id are
never taken as copies; repeated rows share one draw; very long texts are read whole;
extra columns go along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import line_dedup, mixing, ngram_join, sentencepiece_nbest, toxicity
from tallyforge.scratch import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, toxicity.training_labels(labels)))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many pages of their source share."""
    return line_dedup.line_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the flattened marginals of source, language and topic."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best piece ids of each document, with the next best segmentations and the round trip through decoding."""
    return sentencepiece_nbest.nbest_encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("ngram_jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Training and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
