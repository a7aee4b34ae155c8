"""Projections, filters and predicates (rows in, rows out; pushed down by Catalyst)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..rules import CONTRACT_MIMES, FINANCIAL_KEYWORDS, FINANCIAL_MIMES, MODEL_NAME, NON_FINANCIAL, OBLIGATION_KEYWORDS, PROJECTION_CONTENT


def active_projects(projects: DataFrame, *, status: str = "ACTIVE", columns: Sequence[str] = ("id", "name", "code")) -> DataFrame:
    return projects.filter(F.col("status") == status).select(*columns)


def tasks_without_dates(tasks: DataFrame, projects: DataFrame, *, dates: Sequence[str] = ("start_date", "end_date", "due_date"), limit: int | None = 200) -> DataFrame:
    """Tasks with none of the dates, with their project's name; ``limit`` None gives all."""
    undated = F.lit(True)
    for d in dates:
        undated = undated & F.col(d).isNull()
    named = tasks.filter(undated).join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")
    return named if limit is None else named.orderBy("project_id", "id").limit(limit)


def docs_for_project(documents: DataFrame, project_id=None) -> DataFrame:
    """Documents that are not in the trash, by folder and name; of one project or, by default, of each."""
    kept = documents.filter(~F.col("is_trashed"))
    if project_id is not None:
        kept = kept.filter(F.col("project_id") == project_id)
    return kept.orderBy("project_id", "folder_path", "name")


def entity_external_ids(bridge: DataFrame, entity_type: str, canonical_id=None) -> DataFrame:
    kept = bridge.filter(F.col("entity_type") == entity_type)
    return kept if canonical_id is None else kept.filter(F.col("canonical_id") == canonical_id)


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords a lower-cased text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for word in keywords:
        total = total + F.when(F.contains(low, F.lit(word)), 1).otherwise(0)
    return total


def financial_candidates(documents: DataFrame, *, max_documents: int = 25, total_char_budget: int = 120_000, per_doc_char_cap: int = 20_000) -> DataFrame:
    """Documents worth reading for money, per project: score, rank, and what fits the budgets.

    Columns needed: id, project_id, name, folder_path, mime_type, modified, is_trashed, body.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    where = F.concat_ws(" ", "name", F.coalesce("folder_path", F.lit("")))
    hits = keyword_hits(F.concat_ws(" ", where, F.substring(body, 1, 200_000)), FINANCIAL_KEYWORDS)
    kept = documents.filter(
        ~F.col("is_trashed") & (F.trim(body) != "") & (F.col("mime_type").isNull() | F.col("mime_type").isin(*FINANCIAL_MIMES))
        & ~F.coalesce("name", F.lit("")).rlike(MODEL_NAME) & ~where.rlike(NON_FINANCIAL) & ~F.substring(body, 1, 8000).rlike(PROJECTION_CONTENT)
    )
    scored = kept.withColumn("hits", hits).filter((F.col("hits") > 0) | F.coalesce(F.col("mime_type").isin(*CONTRACT_MIMES), F.lit(False)))
    scored = scored.withColumns({"score": F.greatest("hits", F.lit(1)), "chars": F.least(F.length(body), F.lit(per_doc_char_cap))})
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), F.desc("modified"), "id")
    ranked = scored.withColumns({"rank": F.row_number().over(order), "before": F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    taken = ranked.filter((F.col("rank") <= max_documents) & (F.col("before") < total_char_budget))
    return taken.select("project_id", "id", "score", "rank", F.least(F.col("chars"), F.lit(total_char_budget) - F.col("before")).cast("long").alias("chars"))


def obligation_candidates(documents: DataFrame, *, top: int = 10) -> DataFrame:
    """Documents likely to state obligations: keyword hits (+2 for contract types), best ``top`` per project."""
    hay = F.concat_ws(" ", "name", "folder_path", F.substring(F.coalesce("body", F.lit("")), 1, 4000))
    score = keyword_hits(hay, OBLIGATION_KEYWORDS) + F.when(F.col("mime_type").isin(*CONTRACT_MIMES), 2).otherwise(0)
    scored = documents.filter(~F.col("is_trashed")).withColumn("score", score).filter("score > 0")
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), F.desc("modified"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("project_id", "id", "score", "rank")


def candidate_batches(candidates: DataFrame, *, char_budget: int = 30_000, most_documents: int = 8) -> DataFrame:
    """Batch number of each (project_id, rank, chars) row: greedy in rank order, an oversize row alone.

    The running total starts anew with each batch, which no window frame can say:
    a stream over rows sorted by project and rank carries (project, total, count).
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, batch, used, count = None, 0, 0, 0
        for frame in frames:
            out = []
            for p, chars in zip(frame["project_id"], frame["chars"]):
                if p != project:
                    project, batch, used, count = p, 0, 0, 0
                elif count and (used + chars > char_budget or count >= most_documents):
                    batch, used, count = batch + 1, 0, 0
                used, count = used + chars, count + 1
                out.append(batch)
            yield frame.assign(batch=out)

    dealt = candidates.select("project_id", "id", "rank", "chars").repartition("project_id").sortWithinPartitions("project_id", "rank")
    return dealt.mapInPandas(pack, StructType([*dealt.schema, StructField("batch", LongType())]))


def coerce_vocab(rows: DataFrame, column: str, vocabulary: Sequence[str], default: str) -> DataFrame:
    """The value if it is in the vocabulary, else the default with a warning flag (null: default without one)."""
    value = F.lower(F.trim(column))
    known = value.isin(*vocabulary)
    return rows.withColumns({f"{column}_clean": F.when(known, value).otherwise(default), f"{column}_warning": F.coalesce(~known, F.lit(False))})


def clamp_confidence(value: Column) -> Column:
    """A number within [0, 1], null if it is none."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), None).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def validate_timeline(proposals: DataFrame, tasks: DataFrame, *, today: str) -> DataFrame:
    """Errors (reject) and warnings of proposed windows.

    ``proposals``: id, task_id, start_text, end_text, source; ``tasks``: id, parent_start, parent_end.
    """
    start, end = F.try_to_date("start_text", "yyyy-MM-dd"), F.try_to_date("end_text", "yyyy-MM-dd")
    joined = proposals.join(tasks.select(F.col("id").alias("task_id"), "parent_start", "parent_end"), "task_id", "left").withColumns({"start": start, "end": end})
    errors = F.array_compact(F.array(
        F.when(F.col("start").isNull() & F.col("start_text").isNotNull(), "bad_start"),
        F.when(F.col("end").isNull() & F.col("end_text").isNotNull(), "bad_end"),
        F.when(F.col("end") < F.col("start"), "end_before_start"),
        F.when(F.col("end") < F.lit(today).cast("date"), "end_in_past"),
    ))
    warnings = F.array_compact(F.array(
        F.when((F.col("start") < F.col("parent_start")) | (F.col("end") > F.col("parent_end")), "outside_parent"),
        F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "uncited"),
    ))
    return joined.select("id", "task_id", errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("valid"))


def proposals_list(proposals: DataFrame, labelled: DataFrame, *, status: str | None = None, field_name: str | None = None, limit: int = 100) -> DataFrame:
    """Newest proposals by status and kind, each with the label of its target (``labelled``: id, label)."""
    kept = proposals
    if status is not None:
        kept = kept.filter(F.col("status") == status)
    if field_name is not None:
        kept = kept.filter(F.col("field_name") == field_name)
    return kept.join(labelled, "id", "left").orderBy(F.desc("created_at"), "id").limit(limit)


def citing_proposals(proposals: DataFrame, documents: DataFrame, *, json_col: str = "evidence") -> DataFrame:
    """(document_id, proposal_id) for every document id in a proposal's JSON list."""
    cited = proposals.select(F.col("id").alias("proposal_id"), F.explode(F.array_distinct(F.from_json(json_col, "array<bigint>"))).alias("document_id"))
    return cited.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
