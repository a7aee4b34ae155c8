"""Money reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import TODAY
from ..operators import aggregates as A
from ..operators import filters as S
from .registry import query

_REP = "coalesce(max(case when record_kind = 'total' then amount end), sum(case when record_kind = 'line_item' then amount end), sum(case when coalesce(record_kind, '') <> 'tax' then amount end), 0)"
_BUY = "(?i)quittance|buy-?out|settlement|termination|transaction et quittance|\\btenant\\b|locataire"
_LEASE = "(?i)\\blease\\b|\\bbail\\b|loyer|rental"
_TYPE = f"""case when record_kind = 'tax' then 'tax' when record_kind = 'deposit' then 'deposit'
  when regexp_matches(concat(coalesce(name, ''), ' ', coalesce(folder_path, '')), '{_BUY}') then 'buyout_cost' when regexp_matches(concat(coalesce(name, ''), ' ', coalesce(folder_path, '')), '{_LEASE}') then 'lease_rental'
  when direction = 'client_in' then 'contract_revenue' when direction = 'contractor_out' then 'supplier_cost' else 'other' end"""
_BY_TYPE = f""", typed as (select r.*, {_TYPE} as money_type from financial_record r left join document d on d.id = r.document_id),
per_doc as (select project_id, document_id, money_type, {_REP} as amount from typed group by all),
per_type as (select project_id, money_type, sum(amount) as amount from per_doc group by all),
by_type as (select *, case when sum(amount) over w > 0 then round((sum(case when money_type <> 'other' then amount else 0 end) over w)::double / (sum(amount) over w)::double, 4) end as classified_ratio from per_type window w as (partition by project_id))
"""
_FIN = f""", amounts as (select project_id, document_id, direction, is_rollup, {_REP} as amount, bool_or(doc_role in ('invoice', 'receipt')) as role_ok from financial_record group by all),
conf as (select document_id, bool_or(role_ok) as confirmed from amounts where not is_rollup group by 1),
fin as (select project_id, count(distinct case when not is_rollup then a.document_id end) as documents,
 coalesce(sum(case when not is_rollup and direction = 'client_in' then amount end), 0) as client_in_total, coalesce(sum(case when not is_rollup and direction = 'contractor_out' then amount end), 0) as contractor_out_total,
 coalesce(sum(case when not is_rollup and direction = 'unknown' then amount end), 0) as unknown_total,
 coalesce(sum(case when not is_rollup and confirmed and direction = 'client_in' then amount end), 0) as confirmed_client_in, coalesce(sum(case when not is_rollup and confirmed and direction = 'contractor_out' then amount end), 0) as confirmed_contractor_out,
 coalesce(sum(case when is_rollup and direction = 'client_in' then amount end), 0) as rollup_client_in, coalesce(sum(case when is_rollup and direction = 'contractor_out' then amount end), 0) as rollup_contractor_out
 from amounts a left join conf using (document_id) group by 1)
"""
_STATUS = f"""case when due_at::date < date '{TODAY}' then 'overdue' when due_at::date <= date '{TODAY}' + interval 30 day then 'due_soon' when due_at is not null then 'upcoming' when coalesce(trim(trigger), '') <> '' then 'conditional' else 'open' end"""
_MARKED = f", marked as (select *, {_STATUS} as status from obligation)\n"


@query("bid", sql="select status as stage, sum(amount)::double as total, count(*) as n from bid where status not in ('selected', 'rejected') group by 1")
def deal_pipeline(v):
    return A.pipeline_by_stage(v("bid").withColumnRenamed("status", "stage"), value="amount", closed=("selected", "rejected"))


@query("document", sql="select doc_role as status, sum(stated_total)::double as total, count(*) as n from document where doc_role in ('invoice', 'quote', 'estimate') group by 1")
def ar_aging(v):
    return A.ar_aging(v("document").withColumnRenamed("doc_role", "status"), amount="stated_total", open_statuses=("invoice", "quote", "estimate"))


@query("financial_record", sql=f"select project_id, document_id, direction, ({_REP})::double as amount from financial_record group by 1, 2, 3")
def representative_amount(v):
    return A.document_amounts(v("financial_record"))


@query("financial_record", sql=_FIN + """select project_id, documents, client_in_total::double as client_in_total, contractor_out_total::double as contractor_out_total, unknown_total::double as unknown_total,
 confirmed_client_in::double as confirmed_client_in, confirmed_contractor_out::double as confirmed_contractor_out, rollup_client_in::double as rollup_client_in, rollup_contractor_out::double as rollup_contractor_out,
 (client_in_total - contractor_out_total)::double as margin, (confirmed_client_in - confirmed_contractor_out)::double as confirmed_margin from fin""")
def project_financials(v):
    return A.project_financials(v("financial_record"))


@query("financial_record", sql=_FIN + "select project_id, rollup_client_in::double as rollup_client_in, rollup_contractor_out::double as rollup_contractor_out from fin where exists (select 1 from amounts a where a.project_id = fin.project_id and is_rollup)")
def rollup_crosscheck(v):
    return A.rollup_crosscheck(v("financial_record"))


@query("financial_record", "document", sql="select document_id, case when document_id % 3 = 0 then document_id % 2 = 0 else bool_or(doc_role in ('invoice', 'receipt')) end as confirmed from financial_record group by 1")
def confirmed_docs(v):
    decisions = v("document").filter("id % 3 = 0").select(F.col("id").alias("document_id"), (F.col("id") % 2 == 0).alias("confirmed"))
    return A.confirmed_docs(v("financial_record"), decisions)


@query("financial_record", "document", sql=_BY_TYPE + "select project_id, money_type, amount::double as amount, classified_ratio, coalesce(classified_ratio < 0.5, false) as low_confidence from by_type")
def money_by_type(v):
    return A.money_by_type(v("financial_record"), v("document"))


_MARGINS = """, marked as (select *, amount_type in ('markup', 'contingency', 'tax', 'deposit', 'adjustment', 'other') as alone, bool_or(amount_type = 'total') over (partition by project_id, unit, division_code, side) as has_total from ledger),
eff as (select * from marked where (alone or ((amount_type = 'total') = has_total)) and not (side = 'revenue' and status = 'superseded')),
piv as (select project_id, unit, division_code,
 sum(case when side = 'revenue' and status <> 'proposed' then amount end) as quoted_revenue, nullif(sum(case when side = 'revenue' and status = 'proposed' then amount end), 0) as proposed_revenue,
 nullif(sum(case when side = 'cost' and (cost_status is null or cost_status = 'actual') and amount_type = 'material' then amount end), 0) as mat, nullif(sum(case when side = 'cost' and (cost_status is null or cost_status = 'actual') and amount_type = 'labour' then amount end), 0) as lab,
 nullif(sum(case when side = 'cost' and (cost_status is null or cost_status = 'actual') and amount_type not in ('material', 'labour') then amount end), 0) as oth,
 nullif(sum(case when side = 'cost' and cost_status <> 'actual' then amount end), 0) as pipeline_cost,
 list_sort(list(distinct case when side = 'revenue' or cost_status is null or cost_status = 'actual' then document_id end) filter (side = 'revenue' or cost_status is null or cost_status = 'actual')) as docs
 from eff group by 1, 2, 3),
mar as (select *, case when coalesce(mat, lab, oth) is not null then coalesce(mat, 0) + coalesce(lab, 0) + coalesce(oth, 0) end as cost from piv)
"""


@query("ledger", sql=_MARGINS + """select project_id, unit, division_code, quoted_revenue::double as quoted_revenue, proposed_revenue::double as proposed_revenue, mat::double as actual_material_cost, lab::double as actual_labour_cost,
 pipeline_cost::double as pipeline_cost, cost::double as actual_total_cost, (quoted_revenue - cost)::double as gross_margin,
 case when quoted_revenue is not null and cost is not null then 'ok' when quoted_revenue is not null then 'revenue_only' when cost is not null then 'cost_only' when proposed_revenue is not null then 'proposed_only' else 'unknown_division' end as status_flag,
 coalesce(array_to_string(docs, ','), '') as source_docs from mar""")
def division_margins(v):
    return A.division_margins(v("ledger")).drop("gross_margin_pct").withColumn("source_docs", F.array_join(F.transform("source_docs", lambda x: x.cast("string")), ","))


@query("ledger", "bid", "budget", sql="""
, c as (select l.division_code,
 nullif(sum(case when cost_status = 'quoted' and b.status = 'selected' then l.amount end), 0)::double as quoted_cost, nullif(sum(case when cost_status = 'quoted' and b.status in ('pending', 'recommended') then l.amount end), 0)::double as pending_bids_cost,
 count(distinct case when cost_status = 'quoted' and b.status = 'rejected' then bid_id end) as rejected_bid_count, nullif(sum(case when cost_status = 'committed' then l.amount end), 0) as committed, nullif(sum(case when cost_status is null or cost_status = 'actual' then l.amount end), 0) as actual,
 nullif(sum(case when cost_status = 'unknown' or (cost_status = 'quoted' and b.status is null) then l.amount end), 0)::double as unclassified_cost
 from ledger l left join bid b on b.id = l.bid_id where side = 'cost' group by 1),
q as (select division_code, count(*) as quote_count, count(case when status = 'selected' then 1 end) as selected_quote_count from bid group by 1), g as (select division_code, sum(budget_amount) as budget_amount from budget group by 1)
select division_code, budget_amount::double as budget_amount, quoted_cost, pending_bids_cost, coalesce(rejected_bid_count, 0) as rejected_bid_count, committed::double as committed_cost, actual::double as actual_cost, unclassified_cost,
 coalesce(quote_count, 0) as quote_count, coalesce(selected_quote_count, 0) as selected_quote_count, (budget_amount - coalesce(committed, 0) - coalesce(actual, 0))::double as variance
from g full join c using (division_code) full join q using (division_code)""")
def green_sheet(v):
    return A.green_sheet(v("ledger"), v("bid"), v("budget"))


@query("obligation", sql=_MARKED + """, r as (select *, case status when 'overdue' then 4 when 'due_soon' then 3 when 'conditional' then 2 when 'upcoming' then 1 else 0 end as urgency from marked)
select id, project_id, status, amount::double as amount, row_number() over (partition by project_id order by urgency desc, amount desc, id)::int as place from r""")
def commitments(v):
    return A.commitments(v("obligation"), today=TODAY).select("id", "project_id", "status", "amount", "place")


@query("obligation", sql=_MARKED + """select project_id, coalesce(sum(case when direction = 'owed_to_us' and status = 'overdue' then amount end), 0)::double as receivable_overdue, coalesce(sum(case when direction = 'owed_to_us' and status = 'due_soon' then amount end), 0)::double as receivable_due_soon,
 coalesce(sum(case when direction = 'owed_by_us' and status = 'overdue' then amount end), 0)::double as payable_overdue, (receivable_overdue + receivable_due_soon + payable_overdue)::decimal(24,2)::double as headline from marked group by 1 having headline > 0""")
def value_caught(v):
    return A.value_caught(A.commitments(v("obligation"), today=TODAY))


@query("project", "document", "task", sql="""
, d as (select project_id, count(*) as documents, sum(case when doc_role = 'invoice' then stated_total end) as inv, list(id order by modified desc, id desc)[1:10] as recent from document where not is_trashed group by 1),
t as (select project_id, count(*) as tasks, count(case when start_date is null then 1 end) as dateless from task group by 1)
select p.id as project_id, name, status, coalesce(documents, 0) as documents, coalesce(inv, 0)::double as invoice_total, coalesce(tasks, 0) as tasks, coalesce(dateless, 0) as dateless, coalesce(array_to_string(recent, ','), '') as recent_docs
from project p left join d on d.project_id = p.id left join t on t.project_id = p.id""")
def project_overview(v):
    return A.project_overview(v("project"), v("document"), v("task")).withColumn("recent_docs", F.array_join(F.transform("recent_docs", lambda x: x.cast("string")), ","))


@query("project", "document", "task", sql="""
select 'total' as section, 'projects' as key, count(*) as n from project union all select 'total', 'documents', count(*) from document union all select 'total', 'tasks', count(*) from task
union all select 'category', string_split(folder_path, '/')[-1], count(*) from document group by 2 union all select 'task_status', status, count(*) from task group by 2 union all select 'project_status', status, count(*) from project group by 2""")
def database_overview(v):
    return A.database_overview(v("project"), v("document"), v("task"))


@query("project", "document", "task", "proposal", sql="""
select p.id as project_id, name, coalesce(t.n, 0) as tasks, coalesce(t.d, 0) as dateless, coalesce(d.n, 0) as documents, coalesce(q.n, 0) as pending from project p
left join (select project_id, count(*) as n, count(case when start_date is null then 1 end) as d from task group by 1) t on t.project_id = p.id
left join (select project_id, count(*) as n from document where not is_trashed group by 1) d on d.project_id = p.id
left join (select entity_id, count(*) as n from proposal where status = 'PENDING' and entity_type = 'project' group by 1) q on q.entity_id = p.id""")
def project_list(v):
    return A.project_list(v("project"), v("document"), v("task"), v("proposal"))


@query("project", "document", sql="""
select concat('projects_', lower(status)) as metric, count(*) as n from project group by 1 union all select 'documents', count(*) from document where not is_trashed
union all select 'projects_with_documents', count(distinct project_id) from document where not is_trashed union all select 'documents_with_text', count(*) from document where not is_trashed and coalesce(trim(body), '') <> ''""")
def dashboard_summary(v):
    return A.dashboard_summary(v("project"), v("document"))


@query("receipt", "receipt_line", sql="""
, l as (select receipt_id, count(*) as n from receipt_line group by 1), r as (select receipt.*, duplicate_of is null as live, coalesce(n, 0) > 0 as filled from receipt left join l on receipt_id = id)
select count(*) filter (live) as transactions, count(*) filter (live and is_refund) as refunds, (sum(total) filter (live and not is_refund))::double as gross, coalesce(sum(total) filter (live and is_refund), 0)::double as refunded, (sum(total) filter (live))::double as net,
 count(*) filter (live and detail_status = 'pending') as n_pending, count(*) filter (live and detail_status = 'imported') as n_imported, count(*) filter (live and detail_status = 'unbalanced') as n_unbalanced,
 count(*) filter (live and project_id is not null) as linked, count(*) filter (live and project_id is null) as unresolved, count(*) filter (live and filled) as backfilled, coalesce(sum(total) filter (live and filled and not is_refund), 0)::double as backfilled_spend,
 count(*) filter (not live) as duplicates, coalesce(sum(total) filter (not live), 0)::double as duplicates_amount, round(coalesce(sum(total) filter (live and filled and not is_refund), 0)::double / (sum(total) filter (live and not is_refund))::double * 100, 4) as backfilled_pct from r""")
def purchase_coverage(v):
    return A.purchase_coverage(v("receipt"), v("receipt_line"))


@query("receipt", "project", sql="select r.project_id, case when r.project_id is null then '(unresolved)' else coalesce(name, r.project_id::varchar) end as label, count(*) as transactions, sum(total)::double as net_spend from receipt r left join project p on p.id = r.project_id where duplicate_of is null group by 1, 2")
def spend_by_project(v):
    return A.spend_by_project(v("receipt"), v("project"))


@query("receipt_line", sql="select coalesce(sku, product_name, '?') as item, max(sku) as sku, sum(quantity)::double as quantity, sum(subtotal)::double as spend, count(*) as lines from receipt_line group by 1 order by sum(subtotal) desc, item limit 25")
def top_items(v):
    return A.top_items(v("receipt_line"))


@query("receipt", "receipt_line", sql="""select r.id, coalesce(n, 0) as line_count, s::double as line_sum, (s - subtotal)::double as delta, abs(s - subtotal) <= 0.01 * n + 0.02 as reconciled
from receipt r left join (select receipt_id, count(*) as n, sum(subtotal) as s from receipt_line group by 1) l on l.receipt_id = r.id""")
def reconcile_header(v):
    return A.reconcile_header(v("receipt"), v("receipt_line"))


@query("message", sql="select sender, channel, count(*) as n from message group by 1, 2 having count(*) > 1")
def duplicate_keys(v):
    return A.duplicate_keys(v("message"), "sender", "channel")


@query("text", "vector", sql="select (select count(distinct document_id) from text where coalesce(trim(text), '') <> '') as with_text, (select count(distinct id) from vector) as embedded, (select count(*) from vector) as chunks")
def embedding_coverage(v):
    return A.embedding_coverage(v("text"), v("vector").withColumnRenamed("id", "document_id"))


@query("project", sql="select id, name, code from project where status = 'ACTIVE'")
def active_projects(v):
    return S.active_projects(v("project"))


@query("task", "project", sql="select t.project_id, t.id, t.title, p.name as project_name from task t left join project p on p.id = t.project_id where t.status <> 'TODO' and t.status <> 'DONE' order by 1, 2 limit 200")
def tasks_without_dates(v):
    tasks = v("task").withColumn("start_date", F.when(F.col("status").isin("TODO", "DONE"), F.col("start_date"))).withColumns({"end_date": F.lit(None).cast("date"), "due_date": F.lit(None).cast("date")})
    return S.tasks_without_dates(tasks, v("project")).select("project_id", "id", "title", "project_name")


@query("document", sql="select id, project_id, folder_path, name from document where not is_trashed")
def docs_for_project(v):
    return S.docs_for_project(v("document")).select("id", "project_id", "folder_path", "name")


@query("message", sql="select id as canonical_id, channel as entity_type, sender as external_key from message where channel = 'click'")
def entity_external_ids(v):
    return S.entity_external_ids(v("message").select(F.col("id").alias("canonical_id"), F.col("channel").alias("entity_type"), F.col("sender").alias("external_key")), "click")


def _hits(hay: str, words) -> str:
    return " + ".join(f"(case when contains(lower({hay}), '{w}') then 1 else 0 end)" for w in words)


_HAY = "concat(name, ' ', folder_path, ' ', coalesce(body, ''))"
_CONTRACT = "mime_type in ('application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document')"
_CAND = f""", s as (select *, {_hits(_HAY, S.FINANCIAL_KEYWORDS)} as hits from document where not is_trashed and trim(coalesce(body, '')) <> '' and mime_type <> 'image/jpeg'
 and not regexp_matches(name, '(?i)acquisition model|pro-?forma|projection|valuation|underwriting') and not regexp_matches(concat(name, ' ', folder_path), '(?i)\\bphoto|\\bdrawing|\\bplan view|\\brendering')),
k as (select *, greatest(hits, 1) as score, least(length(body), 20000) as chars from s where hits > 0 or {_CONTRACT}),
o as (select *, row_number() over w as rank, coalesce(sum(chars) over (w rows between unbounded preceding and 1 preceding), 0) as before from k window w as (partition by project_id order by score desc, modified desc, id)),
cand as (select project_id, id, score, rank, least(chars, 120000 - before)::bigint as chars from o where rank <= 25 and before < 120000)
"""


@query("document", sql=_CAND + "select project_id, id, score::int as score, rank::int as rank, chars from cand")
def financial_candidates(v):
    return S.financial_candidates(v("document"))


@query("document", sql=f""", s as (select *, {_hits("concat(name, ' ', folder_path, ' ', coalesce(body, ''))", S.OBLIGATION_KEYWORDS)} + case when {_CONTRACT} then 2 else 0 end as score from document where not is_trashed)
select project_id, id, score::int as score, rank::int as rank from (select *, row_number() over (partition by project_id order by score desc, modified desc, id) as rank from s where score > 0) where rank <= 10""")
def obligation_candidates(v):
    return S.obligation_candidates(v("document"))


@query("document", sql=_CAND + """, r(project_id, id, rank, chars, batch, used, n) as (select project_id, id, rank, chars, 0::bigint, chars, 1 from cand where rank = 1
 union all select c.project_id, c.id, c.rank, c.chars, r.batch + case when r.used + c.chars > 60 or r.n >= 3 then 1 else 0 end, case when r.used + c.chars > 60 or r.n >= 3 then c.chars else r.used + c.chars end, case when r.used + c.chars > 60 or r.n >= 3 then 1 else r.n + 1 end
 from r join cand c on c.project_id = r.project_id and c.rank = r.rank + 1)
select project_id, id, rank::int as rank, chars, batch from r""")
def candidate_batches(v):
    return S.candidate_batches(S.financial_candidates(v("document")), char_budget=60, most_documents=3)


@query("ledger", sql="select document_id, amount_type, case when lower(trim(amount_type)) in ('total', 'material', 'labour') then lower(trim(amount_type)) else 'other' end as amount_type_clean, not (lower(trim(amount_type)) in ('total', 'material', 'labour')) as amount_type_warning from ledger")
def coerce_vocab(v):
    return S.coerce_vocab(v("ledger").select("document_id", "amount_type"), "amount_type", ("total", "material", "labour"), "other")


@query("message", sql="select id, case when id % 7 <> 0 then greatest(0.0, least(1.0, (value / 100)::varchar::double)) end as confidence from message")
def clamp_confidence(v):
    raw = F.when(F.col("id") % 7 == 0, F.lit("high")).otherwise((F.col("value") / 100).cast("string"))
    return v("message").select("id", S.clamp_confidence(raw).alias("confidence"))


@query("task", sql=f""", p as (select project_id * 100 + id as id, case when id = 2 then 'soon' else strftime(start_date, '%Y-%m-%d') end as start_text, strftime(start_date + interval 1 day * (duration - 20), '%Y-%m-%d') as end_text, case when id % 3 = 0 then '' else 'note' end as source, start_date as parent_start, start_date + interval 10 day as parent_end from task),
q as (select *, try_strptime(start_text, '%Y-%m-%d')::date as s, try_strptime(end_text, '%Y-%m-%d')::date as e from p),
r as (select id, list_filter([case when s is null and start_text is not null then 'bad_start' end, case when e is null and end_text is not null then 'bad_end' end, case when e < s then 'end_before_start' end, case when e < date '{TODAY}' then 'end_in_past' end], lambda x: x is not null) as errors,
 list_filter([case when s < parent_start or e > parent_end then 'outside_parent' end, case when source = '' then 'uncited' end], lambda x: x is not null) as warnings from q)
select id, array_to_string(errors, ',') as errors, array_to_string(warnings, ',') as warnings, len(errors) = 0 as valid from r""")
def validate_timeline(v):
    task = v("task").withColumn("key", F.col("project_id") * 100 + F.col("id"))
    proposals = task.select(
        F.col("key").alias("id"), F.col("key").alias("task_id"), F.when(F.col("id") == 2, "soon").otherwise(F.date_format("start_date", "yyyy-MM-dd")).alias("start_text"),
        F.date_format(F.date_add("start_date", F.col("duration") - 20), "yyyy-MM-dd").alias("end_text"), F.when(F.col("id") % 3 == 0, "").otherwise("note").alias("source"),
    )
    windows = task.select(F.col("key").alias("id"), F.col("start_date").alias("parent_start"), F.date_add("start_date", 10).alias("parent_end"))
    return S.validate_timeline(proposals, windows, today=TODAY).select("id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid")
