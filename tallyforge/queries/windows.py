"""Windows, ranking, attention detectors and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import TODAY
from ..operators import aggregates as A
from ..operators import attention as T
from ..operators import joins as J
from ..operators import windows as W
from ..rules import CONTRACT_NAME, STOPWORDS
from .money import _BY_TYPE, _FIN, _MARKED
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in (" + _STOP + ")))"


@query("document", sql="select project_id, modified, id, stated_total::double as stated_total from document qualify row_number() over (partition by project_id order by modified desc, id desc) = 1")
def latest_snapshot(v):
    return W.latest_snapshot(v("document").select("project_id", "modified", "id", "stated_total"), order=("modified", "id"))


_TOPN = ", r as (select project_id, id, row_number() over (partition by project_id order by modified desc, id desc)::int as rank, substr(body, 1, 200) as body from document where not is_trashed and coalesce(trim(body), '') <> '')\n"


@query("document", sql=_TOPN + "select * from r where rank <= 5")
def recent_docs_topn(v):
    return W.recent_docs_topn(v("document"))


@query("document", sql=_TOPN + "select *, sum(length(body) / 4) over (partition by project_id order by rank) <= 20 as kept from r where rank <= 5")
def fit_budget(v):
    return W.fit_budget(W.recent_docs_topn(v("document")), token_budget=20)


@query("receipt", sql="select id, total::double as total from receipt where detail_status = 'pending' and duplicate_of is null and not is_refund order by abs(receipt.total) desc, id limit 50")
def backfill_queue(v):
    return W.backfill_queue(v("receipt")).select("id", "total")


@query("project", "document", sql="""select d.project_id, d.id, concat(p.code, '-', lpad((coalesce(e.last, 0) + row_number() over (partition by d.project_id order by d.id))::varchar, 3, '0')) as number from document d join project p on p.id = d.project_id
left join (select project_id, max(id % 40) as last from document where doc_role = 'invoice' group by 1) e on e.project_id = d.project_id where doc_role = 'quote'""")
def po_sequence(v):
    awards = v("document").filter("doc_role = 'quote'").join(v("project").select(F.col("id").alias("project_id"), "code"), "project_id").select("project_id", "id", "code")
    existing = v("document").filter("doc_role = 'invoice'").select("project_id", F.concat(F.lit("X-"), (F.col("id") % 40).cast("string")).alias("number"))
    return W.po_sequence(awards, existing)


@query("message", sql="""
, w as (select sender, project_hint // 5 as p, sum(pow(0.5, greatest(0.0, (epoch(date_trunc('second', timestamp '2024-01-31 00:00:00')) - epoch(date_trunc('second', sent_at))) / 86400.0) / 7.0)) as weight from message where sent_at >= timestamp '2024-01-17 00:00:00' group by 1, 2),
t as (select sender, p, weight, sum(weight) over (partition by sender) as total, row_number() over (partition by sender order by weight desc, p) as k from w) select sender, p as project_id, round(weight / total, 4) as share from t where k = 1 and round(weight / total, 4) >= 0.6""")
def recency_vote(v):
    return W.recency_vote(v("message").withColumn("project_hint", F.floor(F.col("project_hint") / 5)), now="2024-01-31 00:00:00")


@query("task", "document", sql=f"""
, n as (select project_id as note_id, concat('Task ', project_id % 5 + 1, ' done of ', project_id) as text, project_id from (select distinct project_id from task)),
j as (select t.*, note_id, {_TOK.format('title')} as w, {_TOK.format('text')} as nt, abs(date_diff('day', date '{TODAY}', start_date)) as days from task t join n using (project_id)),
s as (select note_id, id, case when status in ('IN_PROGRESS', 'BLOCKED') then 'active' when status = 'DONE' then 'done' else 'upcoming' end as bucket,
 round(0.5 * case status when 'IN_PROGRESS' then 1.0 when 'BLOCKED' then 0.95 when 'TODO' then 0.55 when 'DONE' then 0.1 else 0.3 end::double + 0.3::double * (len(list_intersect(w, nt))::double / len(w)) + 0.2::double * (case when days <= 7 then 1.0 when days <= 14 then 0.85 when days <= 30 then 0.65 when days <= 60 then 0.45 when days <= 90 then 0.30 else 0.15 end)::double, 6) as score from j)
select *, row_number() over (partition by note_id, bucket order by score desc, id)::int as rank from s""")
def task_relevance(v):
    tasks = v("task")
    notes = tasks.select("project_id").distinct().select("project_id", F.col("project_id").alias("id"), F.concat(F.lit("Task "), (F.col("project_id") % 5 + 1).cast("string"), F.lit(" done of "), F.col("project_id").cast("string")).alias("text"))
    return W.task_relevance(tasks, notes, today=TODAY)


@query("receipt_line", sql=""", l as (select receipt_id, row_number() over (partition by receipt_id order by line_number, part_key, subtotal) as line, case when part_key % 3 = 0 then product_name end as heading from receipt_line)
select receipt_id, line::int as line, last_value(heading ignore nulls) over (partition by receipt_id order by line rows unbounded preceding) as section from l""")
def section_fill(v):
    from pyspark.sql import Window

    line = F.row_number().over(Window.partitionBy("receipt_id").orderBy("line_number", "part_key", "subtotal"))
    lines = v("receipt_line").select("receipt_id", line.alias("line"), F.when(F.col("part_key") % 3 == 0, F.col("product_name")).alias("heading"))
    return W.section_fill(lines, key="receipt_id").drop("heading")


@query("document", sql="select project_id, doc_role, id, name from document qualify row_number() over (partition by project_id, doc_role order by id) = 1")
def first_sheet_of_type(v):
    return W.first_sheet_of_type(v("document").select("project_id", "doc_role", "id", "name"), key="project_id", kind="doc_role", order="id")


@query("claim", sql="""select worker_id, work_date, id, (time_arrived is not null)::int + (time_left is not null)::int + (total_hours_reported is not null)::int as completeness from claim where worker_id is not null and work_date is not null
qualify row_number() over (partition by worker_id, work_date order by completeness desc, source_channel = 'gmail' desc, id) = 1""")
def chosen_member(v):
    return W.chosen_member(v("claim").filter("worker_id is not null and work_date is not null"), "worker_id", "work_date").select("worker_id", "work_date", "id", "completeness")


@query("task", sql="select * from (select project_id, lag(id) over (partition by project_id order by id) as predecessor_id, id as successor_id from task) where predecessor_id is not null")
def sequential_edges(v):
    return W.sequential_edges(v("task"))


@query("receipt", sql="select id, row_number() over (order by receipt.total desc, id) - 1 as rank from receipt")
def distributed_rank(v):
    return W.distributed_rank(v("receipt").select("id", "total"), [F.desc("total"), F.asc("id")]).select("id", "rank")


@query("budget", "ledger", "bid", sql="select division_code from budget union select division_code from ledger union select division_code from bid")
def division_key_union(v):
    return W.key_union(*[v(n).select("division_code") for n in ("budget", "ledger", "bid")])


@query("document", sql="select id, folder_path from document where id % 10 = 3 and folder_path in (select folder_path from document where id % 2 = 0)")
def vanished_files(v):
    docs = v("document").select("id", "folder_path")
    return W.vanished_files(docs, docs.filter("id % 10 <> 3"), docs.filter("id % 2 = 0")).select("id", "folder_path")


@query("document", "proposal", "message", "task", sql="""select project_id, modified::timestamp as at, 'document' as kind, id::varchar as ref from document union all select entity_id, created_at, 'proposal', id::varchar from proposal where entity_type = 'project'
union all select project_hint, sent_at, 'message', id::varchar from message union all select project_id, start_date::timestamp, 'task', id::varchar from task""")
def event_timeline(v):
    at = lambda df, project, at, ref: df.select(F.col(project).alias("project_id"), F.col(at).alias("at"), F.col(ref).alias("ref"))
    return W.event_timeline(document=at(v("document"), "project_id", "modified", "id"), proposal=at(v("proposal").filter("entity_type = 'project'"), "entity_id", "created_at", "id"), message=at(v("message"), "project_hint", "sent_at", "id"), task=at(v("task"), "project_id", "start_date", "id"))


_LOW = "select distinct project_id, 'low_confidence' as category, 'medium' as severity, round(10000 + (1 - classified_ratio) * 1000, 4)::double as weight from by_type where classified_ratio < 0.5"
_LOSS = "select project_id, 'confirmed_loss' as category, 'high' as severity, round((confirmed_contractor_out - confirmed_client_in)::double, 4) as weight from fin where confirmed_client_in > 0 and confirmed_contractor_out > confirmed_client_in and project_id not in (select project_id from by_type where classified_ratio < 0.5)"
_PILE = "select project_id, 'unconfirmed_pile' as category, 'low' as severity, round(greatest(client_in_total - confirmed_client_in, contractor_out_total - confirmed_contractor_out)::double, 4) as weight from fin where greatest(client_in_total - confirmed_client_in, contractor_out_total - confirmed_contractor_out) >= 20000 and documents >= 2"
_GAPS = "select entity_id as project_id, 'scope_gaps' as category, 'medium' as severity, (count(*) * 100)::double as weight from proposal where status = 'PENDING' and field_name = 'scope_gap' and entity_type = 'project' group by 1"
_LATE = f"select project_id, 'overdue_tasks' as category, case when count(*) >= 5 or date_diff('day', min((start_date + interval 1 day * duration)::date), date '{TODAY}') >= 30 then 'high' else 'medium' end as severity, (count(*) * 100 + date_diff('day', min((start_date + interval 1 day * duration)::date), date '{TODAY}'))::double as weight from task where status not in ('DONE', 'CANCELLED') and (start_date + interval 1 day * duration)::date < date '{TODAY}' group by 1"
_NOC = "select id as project_id, 'missing_contract' as category, case when status = 'ACTIVE' then 'medium' else 'low' end as severity, 50.0::double as weight from project p where status in ('ACTIVE', 'PROPOSED') and id % 10 <> 9 and not exists (select 1 from document d where d.project_id = p.id and not is_trashed and regexp_matches(d.name, '(?i)contract|agreement|contrat|entente'))"


def _owed(direction: str, status: str, category: str, severity: str) -> str:
    which = f"direction = '{direction}' and " if direction else ""
    return f"select project_id, '{category}' as category, '{severity}' as severity, round(sum(amount)::double, 4) as weight from marked where {which}status = '{status}' group by 1"


_REC, _PAY, _SOON = _owed("owed_to_us", "overdue", "overdue_receivable", "high"), _owed("owed_by_us", "overdue", "overdue_payable", "high"), _owed("", "due_soon", "due_soon", "medium")


def _money(v):
    return A.money_by_type(v("financial_record"), v("document"))


@query("financial_record", "document", sql=_BY_TYPE + _LOW)
def detect_low_confidence(v):
    return T.low_confidence(_money(v))


@query("financial_record", "document", sql=_BY_TYPE + _FIN + _LOSS)
def detect_confirmed_loss(v):
    return T.confirmed_loss(A.project_financials(v("financial_record")), T.low_confidence(_money(v)))


@query("financial_record", sql=_FIN + _PILE)
def detect_unconfirmed_pile(v):
    return T.unconfirmed_pile(A.project_financials(v("financial_record")))


@query("proposal", sql=_GAPS)
def detect_scope_gaps(v):
    return T.scope_gaps(v("proposal").filter("entity_type = 'project'").withColumnRenamed("entity_id", "project_id"))


def _dated(v):
    return v("task").withColumn("due_date", F.date_add("start_date", F.col("duration")))


@query("task", sql=_LATE)
def detect_overdue_tasks(v):
    return T.overdue_tasks(_dated(v), today=TODAY)


def _missing(v):
    return J.missing_documents(v("project"), v("document"), v("project").filter("id % 10 = 9"), pattern=CONTRACT_NAME)


@query("project", "document", sql=_NOC)
def detect_missing_contract(v):
    return T.missing_contract(_missing(v))


def _marked(v):
    return v("obligation").withColumn("status", A.obligation_status(TODAY))


@query("obligation", sql=_MARKED + _REC)
def detect_overdue_receivable(v):
    return T.overdue_receivable(_marked(v))


@query("obligation", sql=_MARKED + _PAY)
def detect_overdue_payable(v):
    return T.overdue_payable(_marked(v))


@query("obligation", sql=_MARKED + _SOON)
def detect_due_soon(v):
    return T.due_soon(_marked(v))


@query("financial_record", "document", "proposal", "task", "project", "obligation", sql=_BY_TYPE + _FIN + _MARKED + ", items as (" + " union all ".join((_LOW, _LOSS, _PILE, _GAPS, _LATE, _NOC, _REC, _PAY, _SOON)) + ") select * from items order by case severity when 'high' then 3 when 'medium' then 2 else 1 end desc, weight desc, project_id, category limit 25")
def attention_briefing(v):
    fin, low, marked = A.project_financials(v("financial_record")), T.low_confidence(_money(v)), _marked(v)
    return T.briefing(
        low, T.confirmed_loss(fin, low), T.unconfirmed_pile(fin), T.scope_gaps(v("proposal").filter("entity_type = 'project'").withColumnRenamed("entity_id", "project_id")),
        T.overdue_tasks(_dated(v), today=TODAY), T.missing_contract(_missing(v)), T.overdue_receivable(marked), T.overdue_payable(marked), T.due_soon(marked),
    )
