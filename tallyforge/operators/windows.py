"""Ranking, running totals and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_tokens
from ..rules import TASK_STATUS_SCORES
from ..scratch import Scratch, shuffled


def latest_snapshot(snapshots: DataFrame, *, key: str = "project_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The newest row of each key: one aggregate, no sort of the groups."""
    return snapshots.groupBy(key).agg(F.max(F.struct(*order, F.struct(*[c for c in snapshots.columns if c not in (*order, key)]).alias("rest"))).alias("m")).select(key, *[F.col(f"m.{c}") for c in order], "m.rest.*")


def recent_docs_topn(documents: DataFrame, *, n: int = 5, clip: int = 200) -> DataFrame:
    """The n most recent documents with text of each project, bodies clipped."""
    order = Window.partitionBy("project_id").orderBy(F.desc("modified"), F.desc("id"))
    kept = documents.filter(~F.col("is_trashed") & (F.coalesce(F.trim("body"), F.lit("")) != ""))
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("project_id", "id", "rank", F.substring("body", 1, clip).alias("body"))


def fit_budget(bodies: DataFrame, *, token_budget: int) -> DataFrame:
    """Newest bodies first until characters / 4 pass the budget; ``kept`` says which fit."""
    order = Window.partitionBy("project_id").orderBy("rank")
    used = F.sum(F.length("body") / 4).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return bodies.withColumn("kept", used <= token_budget)


def backfill_queue(receipts: DataFrame, *, limit: int = 50, include_refunds: bool = False) -> DataFrame:
    """Pending receipts, largest absolute totals first."""
    kept = receipts.filter("detail_status = 'pending' and duplicate_of is null")
    if not include_refunds:
        kept = kept.filter(~F.col("is_refund"))
    return kept.orderBy(F.desc(F.abs("total")), "id").limit(limit)


def po_sequence(awards: DataFrame, existing: DataFrame, *, width: int = 3) -> DataFrame:
    """The next order numbers ``{code}-{PPP}`` of each project after its highest existing one, in id order."""
    last = existing.groupBy("project_id").agg(F.max(F.regexp_extract("number", r"-(\d+)$", 1).try_cast("int")).alias("last"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("id"))
    number = F.concat("code", F.lit("-"), F.lpad((F.coalesce("last", F.lit(0)) + F.col("place")).cast("string"), width, "0"))
    return awards.withColumn("place", place).join(last, "project_id", "left").select("project_id", "id", number.alias("number"))


def recency_vote(messages: DataFrame, *, now: str, half_life_days: float = 7.0, window_days: int = 14, dominance: float = 0.6) -> DataFrame:
    """Per sender the project with most recency-weighted messages, if its share reaches ``dominance``."""
    at = F.lit(now).cast("timestamp")
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(at) - F.unix_timestamp("sent_at")) / 86400.0)
    recent = messages.filter(F.col("project_hint").isNotNull() & (F.col("sent_at") >= at - F.expr(f"interval {window_days} days")))
    weights = recent.groupBy("sender", "project_hint").agg(F.sum(F.pow(F.lit(0.5), age / half_life_days)).alias("weight"))
    best = weights.groupBy("sender").agg(F.max(F.struct("weight", (-F.col("project_hint")).alias("p"))).alias("m"), F.sum("weight").alias("total"))
    share = F.round(F.col("m.weight") / F.col("total"), 4)
    return best.select("sender", (-F.col("m.p")).alias("project_id"), share.alias("share")).filter(F.col("share") >= dominance)


def task_bucket(status: Column) -> Column:
    return F.when(status.isin("IN_PROGRESS", "BLOCKED"), "active").when(status == "DONE", "done").otherwise("upcoming")


def task_relevance(tasks: DataFrame, notes: DataFrame, *, today: str, keep_done: int = 30) -> DataFrame:
    """Tasks of each note's project by 0.5 status + 0.3 share of title words in the note + 0.2 nearness of dates; rank in bucket, best ``keep_done`` of the done ones."""
    status = F.lit(0.30)
    for name, score in TASK_STATUS_SCORES.items():
        status = F.when(F.col("status") == name, score).otherwise(status)
    days = F.abs(F.datediff("start_date", F.lit(today).cast("date")))
    near = F.when(days.isNull(), 0.5).when(days <= 7, 1.0).when(days <= 14, 0.85).when(days <= 30, 0.65).when(days <= 60, 0.45).when(days <= 90, 0.30).otherwise(0.15)
    words, note = keyword_tokens(F.col("title")), F.col("note_tokens")
    recall = F.when((F.size(words) > 0) & (F.size(note) > 0), F.size(F.array_intersect(words, note)) / F.size(words)).otherwise(0.0)
    joined = tasks.join(notes.select("project_id", F.col("id").alias("note_id"), keyword_tokens(F.col("text")).alias("note_tokens")), "project_id")
    scored = joined.withColumns({"score": F.round(0.5 * status + 0.3 * recall + 0.2 * near, 6), "bucket": task_bucket(F.col("status"))})
    order = Window.partitionBy("note_id", "bucket").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter((F.col("bucket") != "done") | (F.col("rank") <= keep_done)).select("note_id", "id", "bucket", "score", "rank")


def section_fill(lines: DataFrame, *, key: str = "document_id", order: str = "line", heading: str = "heading") -> DataFrame:
    """Each line with the last heading at or before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def first_sheet_of_type(sections: DataFrame, *, key: str = "document_id", kind: str = "sheet_type", order: str = "position") -> DataFrame:
    """Of each document's sections of one type the first."""
    rest = F.struct(*[c for c in sections.columns if c not in (key, kind, order)])
    return sections.groupBy(key, kind).agg(F.min(F.struct(order, rest.alias("rest"))).alias("m")).select(key, kind, F.col(f"m.{order}"), "m.rest.*")


def chosen_member(claims: DataFrame, *keys: str) -> DataFrame:
    """Of each group the most complete claim, the supervisor's sheet on a tie, then the smallest id."""
    full = sum((F.col(c).isNotNull().cast("int") for c in ("time_left", "total_hours_reported")), F.col("time_arrived").isNotNull().cast("int"))
    order = Window.partitionBy(*keys).orderBy(F.desc("completeness"), F.desc(F.col("source_channel") == "gmail"), "id")
    return claims.withColumn("completeness", full).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def sequential_edges(tasks: DataFrame, *, key: str = "project_id", order: str = "id") -> DataFrame:
    """Each task depends on the one before it in its group."""
    prior = F.lag(order).over(Window.partitionBy(key).orderBy(order))
    return tasks.select(key, prior.alias("predecessor_id"), F.col(order).alias("successor_id")).filter("predecessor_id is not null")


def distributed_rank(rows: DataFrame, order: list[Column], *, by: tuple[str, ...] = (), partitions: int = 0, name: str = "rank") -> DataFrame:
    """Exact 0-based rank, over all rows or within ``by``, without a window over all rows of a group.

    Rows are range-partitioned by (by, order), so a large group spans partitions; a
    window inside each partition gives local ranks, and counts per (partition, by)
    make them global.
    """
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *[F.asc(c) for c in by], *order).withColumn("_part", F.spark_partition_id())
    # Written once: range bounds are sampled, so a second run could deal the rows out otherwise.
    local = Scratch(rows.sparkSession).keep(ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1), "ranks")
    sizes = local.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", *by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return local.join(shuffled(before) if by else before, ["_part", *by]).withColumn(name, (F.col("_offset") + F.col("_local")).cast("long")).drop("_part", "_local", "_offset")


def key_union(*parts: DataFrame) -> DataFrame:
    """Distinct keys of several tables (first column of each)."""
    out = parts[0].select(parts[0].columns[0])
    for p in parts[1:]:
        out = out.union(p.select(p.columns[0]))
    return out.distinct()


def vanished_files(before: DataFrame, now: DataFrame, visited: DataFrame, *, failures: int = 0) -> DataFrame:
    """Files seen before and not now, under folders that were visited; none if the listing had failures."""
    gone = before.join(now.select("id"), "id", "left_anti").join(visited.select("folder_path").distinct(), "folder_path", "left_semi")
    return gone if not failures else gone.limit(0)


def event_timeline(**events: DataFrame) -> DataFrame:
    """(project_id, at, kind, ref) of several event tables with columns project_id, at, ref."""
    out = None
    for kind, df in events.items():
        part = df.select("project_id", F.col("at").cast("timestamp").alias("at"), F.lit(kind).alias("kind"), F.col("ref").cast("string").alias("ref")).filter("at is not null")
        out = part if out is None else out.unionByName(part)
    return out
