"""Detectors of what needs attention, and the briefing that unites them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("project_id", "category", "severity", "weight")


def _item(df: DataFrame, category: str, severity: Column | str, weight: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("project_id", F.lit(category).alias("category"), level.alias("severity"), F.round(weight.cast("double"), 4).alias("weight"))


def low_confidence(money: DataFrame) -> DataFrame:
    """Under half of the money classified. ``money``: project_id, classified_ratio."""
    weak = money.select("project_id", "classified_ratio").distinct().filter("classified_ratio < 0.5")
    return _item(weak, "low_confidence", "medium", 10_000 + (1 - F.col("classified_ratio")) * 1000)


def confirmed_loss(financials: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Confirmed cost above confirmed revenue, but for projects of low confidence."""
    loss = financials.filter("confirmed_client_in > 0 and confirmed_contractor_out > confirmed_client_in").join(suppressed.select("project_id"), "project_id", "left_anti")
    return _item(loss, "confirmed_loss", "high", F.col("confirmed_contractor_out") - F.col("confirmed_client_in"))


def unconfirmed_pile(financials: DataFrame, *, least: float = 20_000, documents: int = 2) -> DataFrame:
    gap_in, gap_out = F.col("client_in_total") - F.col("confirmed_client_in"), F.col("contractor_out_total") - F.col("confirmed_contractor_out")
    pile = F.greatest(gap_in, gap_out)
    return _item(financials.filter((pile >= least) & (F.col("documents") >= documents)), "unconfirmed_pile", "low", pile)


def scope_gaps(proposals: DataFrame) -> DataFrame:
    """Pending scope-gap proposals per project (project_id, field_name, status)."""
    n = proposals.filter("status = 'PENDING' and field_name = 'scope_gap' and project_id is not null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return _item(n, "scope_gaps", "medium", F.col("n") * 100)


def overdue_tasks(tasks: DataFrame, *, today: str) -> DataFrame:
    """Unfinished tasks past their due date: high at 5 tasks or 30 days."""
    late = tasks.filter(~F.col("status").isin("DONE", "CANCELLED") & (F.col("due_date") < F.lit(today).cast("date")))
    n = late.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.lit(today).cast("date"), F.min("due_date")).alias("days"))
    return _item(n, "overdue_tasks", F.when((F.col("n") >= 5) | (F.col("days") >= 30), "high").otherwise("medium"), F.col("n") * 100 + F.col("days"))


def missing_contract(missing: DataFrame) -> DataFrame:
    """Projects without a contract (id, status)."""
    return _item(missing.withColumnRenamed("id", "project_id"), "missing_contract", F.when(F.col("status") == "ACTIVE", "medium").otherwise("low"), F.lit(50))


def _owed(marked: DataFrame, direction: str, status: str, category: str, severity: str, each: int) -> DataFrame:
    n = marked.filter((F.col("direction") == direction) & (F.col("status") == status)).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return _item(n, category, severity, F.when(F.coalesce("amount", F.lit(0)) > 0, F.col("amount")).otherwise(F.col("n") * each))


def overdue_receivable(marked: DataFrame) -> DataFrame:
    return _owed(marked, "owed_to_us", "overdue", "overdue_receivable", "high", 100)


def overdue_payable(marked: DataFrame) -> DataFrame:
    return _owed(marked, "owed_by_us", "overdue", "overdue_payable", "high", 100)


def due_soon(marked: DataFrame) -> DataFrame:
    n = marked.filter("status = 'due_soon'").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return _item(n, "due_soon", "medium", F.when(F.coalesce("amount", F.lit(0)) > 0, F.col("amount")).otherwise(F.col("n") * 10))


def briefing(*detectors: DataFrame, limit: int = 25) -> DataFrame:
    """The most pressing items of all detectors: severity, then weight, then project and category."""
    union = detectors[0]
    for d in detectors[1:]:
        union = union.unionByName(d)
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return union.orderBy(rank.desc(), F.desc("weight"), "project_id", "category").limit(limit)
