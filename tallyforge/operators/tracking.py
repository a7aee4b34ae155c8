"""Upserts, change tracking and data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import civic_numbers
from .joins import civic_match


def entity_id(source: str, *key: str):
    """A derived id: a re-run gives the same one."""
    return F.sha2(F.concat_ws("/", F.lit(source), *key), 256)


def resolve_or_create(incoming: DataFrame, bridge: DataFrame, entities: DataFrame, *, source: str, create_only: tuple[str, ...] = ()) -> DataFrame:
    """Incoming rows (external_key, name, …) with their canonical id and how it came: known key, matched, or created.

    ``bridge``: external_key, canonical_id; ``entities``: id, name, …. A known row keeps the stored value of create-only attributes.
    """
    known = incoming.join(bridge.select("external_key", "canonical_id"), "external_key", "left")
    fresh = known.filter("canonical_id is null").select(F.col("name").alias("key"))
    hits = civic_match(fresh, entities).select(F.col("key").alias("name"), F.col("target").cast("string").alias("matched_id"))
    joined = known.join(hits, "name", "left")
    cid = F.coalesce(F.col("canonical_id").cast("string"), "matched_id", entity_id(source, F.col("external_key").cast("string")))
    how = F.when(F.col("canonical_id").isNotNull(), "known").when(F.col("matched_id").isNotNull(), "matched").otherwise("created")
    out = joined.withColumns({"entity_id": cid, "outcome": how}).drop("canonical_id", "matched_id")
    stored = entities.select(F.col("id").cast("string").alias("entity_id"), *[F.col(c).alias(f"_{c}") for c in create_only])
    out = out.join(stored, "entity_id", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in create_only}).drop(*[f"_{c}" for c in create_only])


def upsert_keep_decision(stored: DataFrame, fresh: DataFrame, *, key: str = "dedupe_key", decisions: tuple[str, ...] = ("status", "decided_by")) -> DataFrame:
    """Facts from ``fresh`` (else as stored), decisions from ``stored`` (else as fresh)."""
    facts = [c for c in fresh.columns if c not in (key, *decisions)]
    a = stored.select(key, *[F.col(c).alias(f"_s_{c}") for c in (*facts, *decisions)], F.lit(True).alias("_in"))
    b = fresh.select(key, *[F.col(c).alias(f"_f_{c}") for c in (*facts, *decisions)], F.lit(True).alias("_new"))
    joined = a.join(b, key, "full_outer")
    fact = [F.when(F.col("_new"), F.col(f"_f_{c}")).otherwise(F.col(f"_s_{c}")).alias(c) for c in facts]
    kept = [F.when(F.col("_in"), F.col(f"_s_{c}")).otherwise(F.col(f"_f_{c}")).alias(c) for c in decisions]
    return joined.select(key, *fact, *kept)


def supersede_pending(proposals: DataFrame) -> DataFrame:
    """Of the pending proposals of one target and field the newest stays; older ones become superseded."""
    key = ["entity_type", "entity_id", "field_name"]
    newest = F.row_number().over(Window.partitionBy(*key, F.col("status") == "PENDING").orderBy(F.desc("created_at"), F.desc("id")))
    return proposals.withColumn("_k", newest).withColumn("status", F.when((F.col("status") == "PENDING") & (F.col("_k") > 1), "SUPERSEDED").otherwise(F.col("status"))).drop("_k")


def dismiss_stale(proposals: DataFrame, *, now: str, days: int = 14) -> DataFrame:
    """Pending proposals older than ``days`` become rejected, with a reason."""
    stale = (F.col("status") == "PENDING") & (F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return proposals.withColumns({"reason": F.when(stale, F.lit(f"stale: pending over {days} days")), "status": F.when(stale, "REJECTED").otherwise(F.col("status"))})


def weekly_changes(events: DataFrame, *, now: str, days: int = 7) -> DataFrame:
    """Per project (null: projectless) counts by kind in the window that ends today and in the one before; windows begin at midnight.

    ``events``: project_id, at, kind.
    """
    end = F.date_add(F.lit(now).cast("date"), 1)
    day = F.col("at").cast("date")
    this, prior = (day >= F.date_sub(end, days)) & (day < end), (day >= F.date_sub(end, 2 * days)) & (day < F.date_sub(end, days))
    kept = events.filter(this | prior)
    return kept.groupBy("project_id", "kind").agg(F.count(F.when(this, 1)).alias("now"), F.count(F.when(prior, 1)).alias("before")).withColumn("change", F.col("now") - F.col("before"))


def relink(receipts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Project links by a new resolution (key, target, method) of job names; manual links stay. ``changed`` tells which moved."""
    joined = receipts.join(resolved.select(F.col("key").alias("job_name"), F.col("target").alias("_t"), F.col("method").alias("_m")), "job_name", "left")
    manual = F.col("match_method") == "manual"
    return joined.withColumns({"new_project_id": F.when(manual, F.col("project_id")).otherwise(F.col("_t")), "new_method": F.when(manual, "manual").otherwise(F.coalesce("_m", F.lit("unresolved")))}).withColumn("changed", ~F.col("new_project_id").eqNullSafe(F.col("project_id"))).drop("_t", "_m")


def project_doctor(projects: DataFrame, documents: DataFrame, tasks: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Per project: documents, tasks and flags (no folder, empty record); placeholders have none."""
    docs = documents.filter(~F.col("is_trashed")).groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"), F.count("folder_path").alias("folders"))
    work = tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("tasks"))
    joined = projects.select(F.col("id").alias("project_id")).join(docs, "project_id", "left").join(work, "project_id", "left").join(placeholders.select(F.col("id").alias("project_id"), F.lit(True).alias("_p")), "project_id", "left").fillna(0, ["documents", "folders", "tasks"])
    real = F.col("_p").isNull()
    flags = F.array_compact(F.array(F.when(real & (F.col("folders") == 0), "no-drive-folder"), F.when(real & (F.col("documents") == 0) & (F.col("tasks") == 0), "empty-record")))
    return joined.select("project_id", "documents", "tasks", flags.alias("flags"))


def orphan_documents(documents: DataFrame) -> DataFrame:
    """Counts per category of documents with a project, and of those with neither project nor category."""
    category = F.coalesce("category", F.lit("(none)"))
    return documents.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("project_id").isNull() & F.col("category").isNull(), 1)).alias("orphans"))


def cost_status_audit(ledger: DataFrame) -> DataFrame:
    """Cost rows without a status, per project."""
    return ledger.filter("side = 'cost' and cost_status is null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


def done_undated(tasks: DataFrame) -> DataFrame:
    """Done tasks without a completion date, per project."""
    return tasks.filter("status = 'DONE' and completed_at is null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


def path_containment(documents: DataFrame, *, pattern: str, most_outside: float = 0.9) -> DataFrame:
    """Share of documents whose top folder lacks the pattern; at ``most_outside`` or more the root is misconfigured."""
    top = F.get(F.split("folder_path", "/"), 0)
    out = documents.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.coalesce(top.rlike(pattern), F.lit(False)), 1)).alias("outside"))
    return out.withColumn("misconfigured", (F.col("n") > 0) & (F.col("outside") >= F.col("n") * most_outside))


def civic_duplicates(projects: DataFrame) -> DataFrame:
    """Civic numbers that more than one project has."""
    own = projects.select("id", F.explode(civic_numbers(F.col("name"))).alias("civic"))
    return own.groupBy("civic").agg(F.countDistinct("id").alias("projects")).filter("projects > 1")


def data_doctor(checks: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(check, level, n, sample) of tables of findings: name -> (level, findings, column to show)."""
    out = None
    for name, (level, found, column) in checks.items():
        row = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(column).cast("string")).alias("sample")).select(F.lit(name).alias("check"), F.when(F.col("n") > 0, level).otherwise("ok").alias("level"), "n", "sample")
        out = row if out is None else out.unionByName(row)
    return out


def rebuild_all(receipts: DataFrame, resolved: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every receipt derived anew: links by the resolution, but manual links and stored decisions (id, detail_status) stay."""
    linked = relink(receipts, resolved)
    kept = linked.join(decisions.select("id", F.col("detail_status").alias("_d")), "id", "left")
    return kept.select("id", F.col("new_project_id").alias("project_id"), F.col("new_method").alias("match_method"), F.coalesce("_d", "detail_status").alias("detail_status"))


def daily_review(overview: DataFrame, pending: DataFrame, budget: DataFrame) -> DataFrame:
    """Overview, pending proposals and budget check of each project in one row."""
    out = overview.join(pending.groupBy("project_id").agg(F.count(F.lit(1)).alias("pending")), "project_id", "left").join(budget.select("project_id", "flagged"), "project_id", "left")
    return out.withColumns({"pending": F.coalesce("pending", F.lit(0)), "budget_flagged": F.coalesce("flagged", F.lit(False))}).drop("flagged")


def finance_home(sheet: DataFrame, bids: DataFrame, items: DataFrame, *, source: str) -> DataFrame:
    """(section, key, n, amount): green sheet, bids by status, scope items by division, and where the rows come from."""
    a = sheet.select(F.lit("green_sheet").alias("section"), F.col("division_code").alias("key"), F.col("quote_count").cast("long").alias("n"), F.col("budget_amount").cast("decimal(24,2)").alias("amount"))
    b = bids.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(24,2)").alias("amount")).select(F.lit("bids").alias("section"), F.col("status").alias("key"), "n", "amount")
    c = items.groupBy("division_code").agg(F.count(F.lit(1)).alias("n")).select(F.lit("scope").alias("section"), F.col("division_code").alias("key"), "n", F.lit(None).cast("decimal(24,2)").alias("amount"))
    d = sheet.agg(F.count(F.lit(1)).alias("n")).select(F.lit("provenance").alias("section"), F.when(F.col("n") > 0, source).otherwise("empty").alias("key"), "n", F.lit(None).cast("decimal(24,2)").alias("amount"))
    return a.unionByName(b).unionByName(c).unionByName(d)
