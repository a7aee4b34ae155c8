"""Money and activity reports: hash aggregates over all projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import BUYOUT, CONFIRMED_ROLES, LEASE, ROLLUP_NAME, STANDALONE_TYPES

MONEY = "decimal(24,2)"



def _sum(column: Column | str, when: Column | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.sum(value if when is None else F.when(when, value)).cast(MONEY)


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0).cast(MONEY))


def pipeline_by_stage(deals: DataFrame, *, stage: str = "stage", value: str = "value", closed: tuple[str, ...] = ("WON", "LOST")) -> DataFrame:
    """Open deals: sum and count per stage."""
    return deals.filter(~F.col(stage).isin(*closed)).groupBy(stage).agg(_or_zero(_sum(value)).alias("total"), F.count(F.lit(1)).alias("n"))


def ar_aging(invoices: DataFrame, *, status: str = "status", amount: str = "amount", open_statuses: tuple[str, ...] = ("SENT", "OVERDUE", "PARTIAL")) -> DataFrame:
    return invoices.filter(F.col(status).isin(*open_statuses)).groupBy(status).agg(_or_zero(_sum(amount)).alias("total"), F.count(F.lit(1)).alias("n"))


def representative_amount() -> Column:
    """Of a group's records one amount: the largest total, else the line items' sum, else the sum of what is not tax (0 if nothing)."""
    kind = F.col("record_kind")
    return F.coalesce(F.max(F.when(kind == "total", F.col("amount"))).cast(MONEY), _sum("amount", kind == "line_item"), _sum("amount", F.coalesce(kind, F.lit("")) != "tax"), F.lit(0).cast(MONEY))


def document_amounts(records: DataFrame, *keys: str) -> DataFrame:
    return records.withColumn("direction", F.coalesce("direction", F.lit("unknown"))).groupBy("project_id", "document_id", "direction", *keys).agg(representative_amount().alias("amount"))


def confirmed_docs(records: DataFrame, decisions: DataFrame | None = None, *, roles: tuple[str, ...] = CONFIRMED_ROLES) -> DataFrame:
    """(document_id, confirmed): the explicit decision, else whether any record has an invoice or receipt role."""
    default = records.groupBy("document_id").agg(F.max(F.coalesce(F.col("doc_role").isin(*roles), F.lit(False))).alias("default"))
    if decisions is None:
        return default.select("document_id", F.col("default").alias("confirmed"))
    return default.join(decisions.select("document_id", "confirmed"), "document_id", "left").select("document_id", F.coalesce("confirmed", "default").alias("confirmed"))


def project_financials(records: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Per project: money in, out and unknown from primary documents, margin, the confirmed view, and rollup documents beside them."""
    primary = records.filter(~F.coalesce("is_rollup", F.lit(False)))
    status = confirmed_docs(primary, decisions)
    amounts = document_amounts(primary).join(status, "document_id")
    sides = {"client_in": "client_in", "contractor_out": "contractor_out", "unknown": "unknown"}
    out = [_or_zero(_sum("amount", F.col("direction") == d)).alias(f"{n}_total") for n, d in sides.items()]
    out += [_or_zero(_sum("amount", (F.col("direction") == d) & F.col("confirmed"))).alias(f"confirmed_{n}") for n, d in sides.items() if n != "unknown"]
    main = amounts.groupBy("project_id").agg(*out, F.countDistinct("document_id").alias("documents"))
    cross = rollup_crosscheck(records)
    joined = main.join(cross, "project_id", "full_outer")
    zero = [_or_zero(F.col(c)).alias(c) for c in (*[f"{n}_total" for n in sides], "confirmed_client_in", "confirmed_contractor_out", "rollup_client_in", "rollup_contractor_out")]
    filled = joined.select("project_id", F.coalesce("documents", F.lit(0)).alias("documents"), *zero)
    return filled.withColumns({"margin": F.col("client_in_total") - F.col("contractor_out_total"), "confirmed_margin": F.col("confirmed_client_in") - F.col("confirmed_contractor_out")})


def rollup_crosscheck(records: DataFrame) -> DataFrame:
    """The same totals over rollup documents only."""
    amounts = document_amounts(records.filter(F.coalesce("is_rollup", F.lit(False))))
    return amounts.groupBy("project_id").agg(_or_zero(_sum("amount", F.col("direction") == "client_in")).alias("rollup_client_in"), _or_zero(_sum("amount", F.col("direction") == "contractor_out")).alias("rollup_contractor_out"))


def money_type(direction: Column, kind: Column, name: Column, folder: Column) -> Column:
    """What kind of money a record is: tax and deposit by kind, buyout and lease by name or folder, then by direction."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    where = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(folder, F.lit("")))
    side = F.lower(F.coalesce(direction, F.lit("")))
    return (
        F.when(low == "tax", "tax").when(low == "deposit", "deposit").when(where.rlike(BUYOUT), "buyout_cost").when(where.rlike(LEASE), "lease_rental")
        .when(side == "client_in", "contract_revenue").when(side == "contractor_out", "supplier_cost").otherwise("other")
    )


def money_by_type(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Per project and money type: the sum of representative amounts per document, its share of the money that is classified, and whether under half is."""
    named = records.join(documents.select(F.col("id").alias("document_id"), "name", "folder_path"), "document_id", "left")
    typed = named.withColumn("money_type", money_type(F.col("direction"), F.col("record_kind"), F.col("name"), F.col("folder_path")))
    per_doc = typed.groupBy("project_id", "document_id", "money_type").agg(representative_amount().alias("amount"))
    per_type = per_doc.groupBy("project_id", "money_type").agg(_sum("amount").alias("amount"))
    shares = per_type.groupBy("project_id").agg(_sum("amount").alias("all_money"), _or_zero(_sum("amount", F.col("money_type") != "other")).alias("known"))
    ratio = F.when(F.col("all_money") > 0, F.round(F.col("known").cast("double") / F.col("all_money").cast("double"), 4))
    return per_type.join(shares.select("project_id", ratio.alias("classified_ratio")), "project_id").withColumn("low_confidence", F.coalesce(F.col("classified_ratio") < 0.5, F.lit(False)))


def is_rollup_name(name: Column) -> Column:
    return F.coalesce(name.rlike(ROLLUP_NAME), F.lit(False))


def effective_rows(ledger: DataFrame, *keys: str) -> DataFrame:
    """Ledger rows that count: standalone types always; of the others a group's totals if it has any, else its items."""
    from pyspark.sql import Window

    group = Window.partitionBy(*keys)
    kind = F.col("amount_type")
    alone = F.coalesce(kind.isin(*STANDALONE_TYPES), F.lit(False))
    marked = ledger.withColumns({"_alone": alone, "_total": F.max(F.coalesce(kind == "total", F.lit(False))).over(group)})
    return marked.filter(F.col("_alone") | (F.coalesce(kind == "total", F.lit(False)) == F.col("_total"))).drop("_alone", "_total")


def division_margins(ledger: DataFrame) -> DataFrame:
    """Per project, unit and division: quoted and proposed revenue, actual and pipeline cost, margin, percentage, flag, source documents."""
    rows = effective_rows(ledger, "project_id", "unit", "division_code", "side")
    status = F.coalesce("status", F.lit("unknown"))
    revenue = F.col("side") == "revenue"
    rows = rows.filter(~(revenue & (status == "superseded")))
    sold, proposed = revenue & (status != "proposed"), revenue & (status == "proposed")
    actual = (F.col("side") == "cost") & (F.col("cost_status").isNull() | (F.col("cost_status") == "actual"))
    pipeline = (F.col("side") == "cost") & ~(F.col("cost_status").isNull() | (F.col("cost_status") == "actual"))
    nothing = F.lit(0).cast(MONEY)
    kind = F.coalesce("amount_type", F.lit(""))
    summed = rows.groupBy("project_id", "unit", "division_code").agg(
        _sum("amount", sold).alias("quoted_revenue"), F.nullif(_sum("amount", proposed), nothing).alias("proposed_revenue"),
        F.nullif(_sum("amount", actual & (kind == "material")), nothing).alias("actual_material_cost"), F.nullif(_sum("amount", actual & (kind == "labour")), nothing).alias("actual_labour_cost"),
        F.nullif(_sum("amount", actual & ~kind.isin("material", "labour")), nothing).alias("actual_other_cost"), F.nullif(_sum("amount", pipeline), nothing).alias("pipeline_cost"),
        F.array_sort(F.collect_set(F.when(revenue | actual, F.col("document_id")))).alias("source_docs"),
    )
    parts = [F.col(f"actual_{k}_cost") for k in ("material", "labour", "other")]
    cost = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, nothing) for p in parts[1:]), F.coalesce(parts[0], nothing)).cast(MONEY))
    out = summed.withColumn("actual_total_cost", cost)
    out = out.withColumn("gross_margin", (F.col("quoted_revenue") - F.col("actual_total_cost")).cast(MONEY))
    pct = F.when(F.col("quoted_revenue") != 0, F.bround((F.col("gross_margin") * 100 / F.col("quoted_revenue")).cast("decimal(38,12)"), 1).cast("double"))
    flag = (
        F.when(F.col("division_code") == "99", "unknown_division").when(F.col("gross_margin").isNotNull(), "ok").when(F.col("quoted_revenue").isNotNull(), "revenue_only")
        .when(F.col("actual_total_cost").isNotNull(), "cost_only").when(F.col("proposed_revenue").isNotNull(), "proposed_only").otherwise("unknown_division")
    )
    return out.drop("actual_other_cost").withColumns({"gross_margin_pct": pct, "status_flag": flag})


def green_sheet(cost_rows: DataFrame, bids: DataFrame, budget: DataFrame, packages: DataFrame | None = None, *keys: str) -> DataFrame:
    """Per division: budget, selected quotes, pending bids, rejected bids, committed, actual and unclassified cost, variance and counts."""
    keys = keys or ("division_code",)
    status = cost_rows.filter(F.col("side") == "cost").join(bids.select(F.col("id").alias("bid_id"), F.col("status").alias("bid_status")), "bid_id", "left")
    state, bid = F.col("cost_status"), F.col("bid_status")
    actual = state.isNull() | (state == "actual")
    quoted = F.coalesce(state == "quoted", F.lit(False))
    selected, pending = quoted & F.coalesce(bid == "selected", F.lit(False)), quoted & F.coalesce(bid.isin("pending", "recommended"), F.lit(False))
    rejected, committed = quoted & F.coalesce(bid == "rejected", F.lit(False)), F.coalesce(state == "committed", F.lit(False))
    nothing = F.lit(0).cast(MONEY)
    take = lambda when, name: F.nullif(_sum("amount", when), nothing).alias(name)
    cost = status.groupBy(*keys).agg(
        take(selected, "quoted_cost"), take(pending, "pending_bids_cost"), F.countDistinct(F.when(rejected, F.col("bid_id"))).alias("rejected_bid_count"),
        take(committed, "committed_cost"), take(actual, "actual_cost"), take(~(actual | selected | pending | rejected | committed), "unclassified_cost"),
    )
    counts = bids.groupBy(*keys).agg(F.count(F.lit(1)).alias("quote_count"), F.count(F.when(F.col("status") == "selected", 1)).alias("selected_quote_count"))
    out = budget.groupBy(*keys).agg(_sum("budget_amount").alias("budget_amount")).join(cost, list(keys), "full_outer").join(counts, list(keys), "full_outer")
    if packages is not None:
        out = out.join(packages.groupBy(*keys).agg(F.count(F.lit(1)).alias("package_count")), list(keys), "full_outer").fillna(0, ["package_count"])
    exposure = F.coalesce("committed_cost", nothing) + F.coalesce("actual_cost", nothing)
    return out.fillna(0, ["quote_count", "selected_quote_count", "rejected_bid_count"]).withColumn("variance", (F.col("budget_amount") - exposure).cast(MONEY))


def obligation_status(today: str, *, due_soon_days: int = 30, due: str = "due_at") -> Column:
    day, now = F.col(due).cast("date"), F.lit(today).cast("date")
    return (
        F.when(day < now, "overdue").when(day <= F.date_add(now, due_soon_days), "due_soon").when(day.isNotNull(), "upcoming")
        .when(F.coalesce(F.trim("trigger"), F.lit("")) != "", "conditional").otherwise("open")
    )


def commitments(obligations: DataFrame, *, today: str, due_soon_days: int = 30) -> DataFrame:
    """Each obligation with its status and place by urgency (later ranks first, then larger amounts, then id) within its project."""
    from pyspark.sql import Window

    status = obligation_status(today, due_soon_days=due_soon_days)
    rank = F.when(F.col("status") == "overdue", 4).when(F.col("status") == "due_soon", 3).when(F.col("status") == "conditional", 2).when(F.col("status") == "upcoming", 1).otherwise(0)
    marked = obligations.withColumn("status", status).withColumn("urgency", rank)
    order = Window.partitionBy("project_id").orderBy(F.desc("urgency"), F.desc(F.coalesce("amount", F.lit(0))), "id")
    return marked.withColumn("place", F.row_number().over(order))


def commitment_totals(marked: DataFrame) -> DataFrame:
    """Per project: obligations owed either way, in total and overdue, and a count per status."""
    us, them, late = F.col("direction") == "owed_to_us", F.col("direction") == "owed_by_us", F.col("status") == "overdue"
    money = [("owed_to_us_total", us), ("owed_to_us_overdue", us & late), ("owed_by_us_total", them), ("owed_by_us_overdue", them & late)]
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("overdue", "due_soon", "upcoming", "conditional", "open")]
    return marked.groupBy("project_id").agg(*[_or_zero(_sum("amount", w)).alias(n) for n, w in money], *counts)


def value_caught(marked: DataFrame) -> DataFrame:
    """Projects with money at stake (overdue or due soon to us, overdue by us), and each one's headline total."""
    us, them = F.col("direction") == "owed_to_us", F.col("direction") == "owed_by_us"
    columns = {"receivable_overdue": us & (F.col("status") == "overdue"), "receivable_due_soon": us & (F.col("status") == "due_soon"), "payable_overdue": them & (F.col("status") == "overdue")}
    summed = marked.groupBy("project_id").agg(*[_or_zero(_sum("amount", w)).alias(n) for n, w in columns.items()])
    return summed.withColumn("headline", sum((F.col(c) for c in list(columns)[1:]), F.col("receivable_overdue")).cast(MONEY)).filter("headline > 0")


def project_list(projects: DataFrame, documents: DataFrame, tasks: DataFrame, proposals: DataFrame) -> DataFrame:
    """Projects with counts of tasks, dateless tasks, documents and pending proposals, 0 where there are none."""
    n_tasks = tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("tasks"), F.count(F.when(F.col("start_date").isNull(), 1)).alias("dateless"))
    n_docs = documents.filter(~F.col("is_trashed")).groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"))
    n_props = proposals.filter("status = 'PENDING' and entity_type = 'project'").groupBy(F.col("entity_id").alias("project_id")).agg(F.count(F.lit(1)).alias("pending"))
    out = projects.select(F.col("id").alias("project_id"), "name")
    for part in (n_tasks, n_docs, n_props):
        out = out.join(part, "project_id", "left")
    return out.fillna(0, ["tasks", "dateless", "documents", "pending"])


def project_overview(projects: DataFrame, documents: DataFrame, tasks: DataFrame, *, recent: int = 10) -> DataFrame:
    """Per project: counts, invoice total, and its most recent documents (id list, newest first)."""
    kept = documents.filter(~F.col("is_trashed"))
    newest = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("modified", "id")))), 1, recent)
    docs = kept.groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"), _sum("stated_total", F.col("doc_role") == "invoice").alias("invoice_total"), F.transform(newest, lambda x: x["id"]).alias("recent_docs"))
    n_tasks = tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("tasks"), F.count(F.when(F.col("start_date").isNull(), 1)).alias("dateless"))
    joined = projects.select(F.col("id").alias("project_id"), "name", "status").join(docs, "project_id", "left").join(n_tasks, "project_id", "left")
    return joined.fillna(0, ["documents", "tasks", "dateless"]).withColumns({"invoice_total": _or_zero(F.col("invoice_total")), "recent_docs": F.coalesce("recent_docs", F.array().cast("array<bigint>"))})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def database_overview(projects: DataFrame, documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """(section, key, n): table totals, documents per folder category, tasks per status, projects per status."""
    totals = table_counts({"projects": projects, "documents": documents, "tasks": tasks}).select(F.lit("total").alias("section"), F.col("table_name").alias("key"), F.col("n_rows").alias("n"))
    by = lambda df, name, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), F.col(key).alias("key"), "n")
    category = documents.withColumn("category", F.element_at(F.split("folder_path", "/"), -1))
    return totals.unionByName(by(category, "category", "category")).unionByName(by(tasks, "task_status", "status")).unionByName(by(projects, "project_status", "status"))


def dashboard_summary(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Status counts of projects and facts about documents as (metric, n)."""
    status = projects.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("projects_"), F.lower("status")).alias("metric"), "n")
    kept = documents.filter(~F.col("is_trashed"))
    facts = kept.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("project_id").alias("projects_with_documents"), F.count(F.when(F.coalesce(F.trim("body"), F.lit("")) != "", 1)).alias("documents_with_text"))
    return status.unionByName(facts.unpivot([], ["documents", "projects_with_documents", "documents_with_text"], "metric", "n"))


def purchase_coverage(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """Gross, refunded and net spend, detail status counts, linked and backfilled shares; duplicates left out and counted apart."""
    own = lines.groupBy(F.col("receipt_id").alias("id")).agg(F.count(F.lit(1)).alias("lines"))
    rows = receipts.join(own, "id", "left").withColumn("live", F.col("duplicate_of").isNull())
    live, refund, filled = F.col("live"), F.col("is_refund"), F.coalesce("lines", F.lit(0)) > 0
    total = rows.agg(
        F.count(F.when(live, 1)).alias("transactions"), F.count(F.when(live & refund, 1)).alias("refunds"),
        _or_zero(_sum("total", live & ~refund)).alias("gross"), _or_zero(_sum("total", live & refund)).alias("refunded"), _or_zero(_sum("total", live)).alias("net"),
        *[F.count(F.when(live & (F.col("detail_status") == s), 1)).alias(f"n_{s}") for s in ("pending", "imported", "unbalanced")],
        F.count(F.when(live & F.col("project_id").isNotNull(), 1)).alias("linked"), F.count(F.when(live & F.col("project_id").isNull(), 1)).alias("unresolved"),
        F.count(F.when(live & filled, 1)).alias("backfilled"), _or_zero(_sum("total", live & filled & ~refund)).alias("backfilled_spend"),
        F.count(F.when(~live, 1)).alias("duplicates"), _or_zero(_sum("total", ~live)).alias("duplicates_amount"),
    )
    return total.withColumn("backfilled_pct", F.when(F.col("gross") != 0, F.round(F.col("backfilled_spend").cast("double") / F.col("gross").cast("double") * 100, 4)).otherwise(0.0))


def spend_by_project(receipts: DataFrame, projects: DataFrame) -> DataFrame:
    """Net spend and count per project, unresolved ones in a bucket of their own, with rank by spend."""
    summed = receipts.filter("duplicate_of is null").groupBy("project_id").agg(F.count(F.lit(1)).alias("transactions"), _or_zero(_sum("total")).alias("net_spend"))
    named = summed.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id", "left")
    label = F.when(F.col("project_id").isNull(), "(unresolved)").otherwise(F.coalesce("name", F.col("project_id").cast("string")))
    return named.select("project_id", label.alias("label"), "transactions", "net_spend")


def top_items(lines: DataFrame, *, limit: int = 25) -> DataFrame:
    """Quantity, spend and lines per item (sku, else its name), best by spend."""
    item = F.coalesce("sku", "product_name", F.lit("?"))
    summed = lines.groupBy(item.alias("item")).agg(F.first("sku", ignorenulls=True).alias("sku"), F.sum("quantity").cast("decimal(24,3)").alias("quantity"), _or_zero(_sum("subtotal")).alias("spend"), F.count(F.lit(1)).alias("lines"))
    return summed.orderBy(F.desc("spend"), "item").limit(limit)


def reconcile_header(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """Line count and sum against the header's subtotal: ok within 0.01 per line + 0.02."""
    own = lines.groupBy(F.col("receipt_id").alias("id")).agg(F.count(F.lit(1)).alias("line_count"), _sum("subtotal").alias("line_sum"))
    joined = receipts.select("id", "subtotal").join(own, "id", "left").fillna(0, ["line_count"])
    delta = (F.col("line_sum") - F.col("subtotal")).cast(MONEY)
    slack = (F.lit(0.01).cast("decimal(4,2)") * F.col("line_count") + F.lit(0.02).cast("decimal(4,2)")).cast(MONEY)
    return joined.select("id", "line_count", "line_sum", delta.alias("delta"), (F.abs(delta) <= slack).alias("reconciled"))


def labour_hours(claims: DataFrame) -> DataFrame:
    """Hours per worker, or per raw name where unresolved: entries, days, reported, computed, mismatches, first and last day."""
    who = F.when(F.col("worker_id").isNotNull(), F.concat(F.lit("w:"), F.col("worker_id").cast("string"))).otherwise(F.concat(F.lit("n:"), F.lower(F.trim("employee_name_raw"))))
    return claims.groupBy(who.alias("worker_key")).agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("work_date").alias("days"), _or_zero(_sum("total_hours_reported")).alias("reported"), _or_zero(_sum("total_hours_computed")).alias("computed"),
        F.count(F.when(F.col("hours_mismatch"), 1)).alias("mismatches"), F.min("work_date").alias("first_day"), F.max("work_date").alias("last_day"),
    )


def duplicate_keys(bridge: DataFrame, *keys: str) -> DataFrame:
    return bridge.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def embedding_coverage(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with text, documents with chunks, chunks."""
    have = texts.filter(F.coalesce(F.trim("text"), F.lit("")) != "").agg(F.countDistinct("document_id").alias("with_text"))
    done = chunks.agg(F.countDistinct("document_id").alias("embedded"), F.count(F.lit(1)).alias("chunks"))
    return have.crossJoin(done)  # one row each


def labour_roster(clusters: DataFrame) -> DataFrame:
    """Hours and shifts per worker of confirmed clusters only."""
    sure = clusters.filter(F.col("status").isin("auto_reinforced", "auto_single_source"))
    return sure.groupBy("worker_key").agg(F.count(F.lit(1)).alias("shifts"), _or_zero(_sum("hours")).alias("hours"), F.countDistinct("work_date").alias("days"))
