"""Hours: time sheets, claims and their consolidation into shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import parse_clock, worked_hours
from ..functions.text import normalize_name
from ..rules import AUTO_CLAIM_TYPES

TOLERANCE = 0.25
SOFT_FLAGS = ("low_confidence",)


def validate_time_rows(rows: DataFrame) -> DataFrame:
    """Missing fields, blank test and mismatch (reported and computed hours over a quarter apart) of time sheet rows."""
    arrived, left = parse_clock(F.col("time_arrived")), parse_clock(F.col("time_left"))
    computed = worked_hours(arrived, left, F.col("lunch_hours"))
    missing = F.array_compact(F.array(
        F.when(F.col("work_date").isNull(), "date"), F.when(F.coalesce(F.trim("employee_name_raw"), F.lit("")) == "", "name"),
        F.when(arrived.isNull(), "time_arrived"), F.when(left.isNull(), "time_left"), F.when(F.col("total_hours_reported").isNull(), "total_hours"),
    ))
    blank = arrived.isNull() & left.isNull() & F.col("total_hours_reported").isNull()
    return rows.withColumns({"computed": computed, "missing": missing, "blank": blank, "mismatch": F.coalesce(F.abs(F.col("total_hours_reported") - computed) > TOLERANCE, F.lit(False))})


def bridge_claims(entries: DataFrame, submissions: DataFrame) -> DataFrame:
    """One claim per time sheet entry, with the submission as its source event; ids are derived, so a re-run replaces."""
    joined = entries.join(submissions.select(F.col("id").alias("submission_id"), "message_id", "received_at"), "submission_id")
    claim = F.sha2(F.concat_ws("/", F.lit("gmail"), F.col("id").cast("string")), 256)
    event = F.sha2(F.concat_ws("/", F.lit("email_project_log"), F.col("message_id").cast("string")), 256)
    return joined.select(
        claim.alias("claim_id"), event.alias("source_event_id"), F.lit("gmail").alias("source_channel"), "worker_id", "employee_name_raw", "project_id", "work_date", "total_hours_reported", "total_hours_computed",
        F.when(F.col("total_hours_reported").isNotNull(), "labour_time").otherwise("attendance_only").alias("claim_type"), F.coalesce("hours_mismatch", F.lit(False)).alias("hours_mismatch"), "received_at",
    )


def claim_flags() -> Column:
    """Reasons why a claim needs review."""
    usable = F.col("total_hours_reported").isNotNull() | F.col("total_hours_computed").isNotNull() | (F.col("time_arrived").isNotNull() & F.col("time_left").isNotNull())
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("claim_type").isin(*AUTO_CLAIM_TYPES), F.lit(False)), F.concat(F.lit("claim_type:"), F.coalesce("claim_type", F.lit("unknown")))),
        F.when(F.col("review_status") == "needs_review", "claim_needs_review"), F.when(F.col("source_confidence") < 0.5, "low_confidence"), F.when(F.col("hours_mismatch"), "hours_mismatch"),
        F.when(F.col("worker_id").isNull(), "unresolved_worker"), F.when(F.col("project_id").isNull(), "unresolved_project"), F.when(F.col("work_date").isNull(), "missing_date"), F.when(~usable, "missing_hours"),
    ))


def worker_key() -> Column:
    return F.when(F.col("worker_id").isNotNull(), F.concat(F.lit("w:"), F.col("worker_id").cast("string"))).when(F.col("employee_name_raw").isNotNull(), F.concat(F.lit("n:"), normalize_name(F.col("employee_name_raw"))))


def consolidate_claims(claims: DataFrame, *, soft: tuple[str, ...] = SOFT_FLAGS) -> DataFrame:
    """Shifts: claims of one project, worker and day. A claim without a date or worker key is a cluster of its own.

    One aggregate per cluster; the chosen member is the largest of (completeness,
    supervisor's sheet, smallest id).
    """
    alone = F.col("work_date").isNull() | worker_key().isNull()
    key = F.when(alone, F.concat(F.lit("claim:"), F.col("id").cast("string"))).otherwise(F.concat_ws("|", worker_key(), F.col("work_date").cast("string")))
    full = F.col("time_arrived").isNotNull().cast("int") + F.col("time_left").isNotNull().cast("int") + F.col("total_hours_reported").isNotNull().cast("int")
    chosen = F.max(F.struct(full.alias("full"), (F.col("source_channel") == "gmail").alias("sheet"), (-F.col("id")).alias("neg"), F.coalesce("total_hours_reported", "total_hours_computed").alias("hours")))
    hard = F.exists(claim_flags(), lambda f: ~f.isin(*soft))
    grouped = claims.withColumns({"cluster_key": key, "hard": hard, "alone": alone}).groupBy("project_id", "cluster_key").agg(
        F.max("worker_id").alias("worker_id"), F.max(worker_key()).alias("worker_key"), F.max("work_date").alias("work_date"), F.count(F.lit(1)).alias("members"), F.countDistinct("source_channel").alias("channels"),
        F.coalesce(F.max("total_hours_reported") - F.min("total_hours_reported") > TOLERANCE, F.lit(False)).alias("hours_conflict"), F.max("hard").alias("hard"), F.max(F.col("work_date").isNull()).alias("dateless"), chosen.alias("chosen"),
    )
    status = (
        F.when(F.col("dateless"), "needs_review").when(F.col("hours_conflict"), "conflict").when(F.col("worker_id").isNull() | F.col("hard"), "needs_review")
        .when(F.col("channels") >= 2, "auto_reinforced").otherwise("auto_single_source")
    )
    points = F.lit(50) + F.when(F.col("worker_id").isNotNull(), 20).otherwise(0) + F.when((F.col("channels") >= 2) & ~F.col("hours_conflict"), 20).otherwise(0) + F.when(~F.col("hours_conflict") & ~F.col("dateless"), 10).otherwise(0)
    capped = F.when(status.isin("conflict", "needs_review"), F.least(points, F.lit(40))).otherwise(F.least(points, F.lit(100)))
    return grouped.select("project_id", "cluster_key", "worker_key", "work_date", "members", "channels", status.alias("status"), (capped / 100).alias("confidence"), (-F.col("chosen.neg")).alias("chosen_id"), F.col("chosen.hours").alias("hours"))


def cluster_members(claims: DataFrame) -> DataFrame:
    """(id, rank) of claims within their (project, worker, day): the order in which they support the shift."""
    w = Window.partitionBy("project_id", worker_key(), "work_date").orderBy("id")
    return claims.select("id", F.row_number().over(w).alias("rank"))
