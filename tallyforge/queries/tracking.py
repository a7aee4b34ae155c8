"""Upserts, change tracking and data checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as S
from ..operators import joins as J
from ..operators import tracking as K
from .registry import query

_N = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("document", "project", sql=f""", i as (select distinct project_id as external_key, case when project_id % 3 = 0 then concat('customer#', lpad(project_id::varchar, 9, '0')) else concat('Client ', project_id) end as name, 'NEW' as status from document),
b as (select id as external_key, id::varchar as cid from project where id % 5 = 0), m as (select i.name, min(p.id)::varchar as mid from i join project p on {_N.format('i.name')} = {_N.format('p.name')} where i.external_key not in (select external_key from b) group by 1),
r as (select i.external_key, coalesce(b.cid, m.mid, sha256(concat('mail/', i.external_key))) as entity_id, case when b.cid is not null then 'known' when m.mid is not null then 'matched' else 'created' end as outcome, i.status from i left join b using (external_key) left join m on m.name = i.name)
select r.external_key, r.entity_id, r.outcome, coalesce(p.status, r.status) as status from r left join project p on p.id::varchar = r.entity_id""")
def resolve_or_create(v):
    name = F.when(F.col("project_id") % 3 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("project_id").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("Client "), F.col("project_id").cast("string")))
    incoming = v("document").select(F.col("project_id").alias("external_key"), name.alias("name"), F.lit("NEW").alias("status")).distinct()
    bridge = v("project").filter("id % 5 = 0").select(F.col("id").alias("external_key"), F.col("id").alias("canonical_id"))
    return K.resolve_or_create(incoming, bridge, v("project"), source="mail", create_only=("status",)).select("external_key", "entity_id", "outcome", "status")


@query("document", sql="select id as dedupe_key, case when id % 3 <> 0 then stated_total * 2 else stated_total end::double as amount, case when id % 2 = 0 then 'CONFIRMED' else 'OPEN' end as status from document where id % 2 = 0 or id % 3 <> 0")
def upsert_keep_decision(v):
    stored = v("document").filter("id % 2 = 0").select(F.col("id").alias("dedupe_key"), F.col("stated_total").alias("amount"), F.lit("CONFIRMED").alias("status"))
    fresh = v("document").filter("id % 3 <> 0").select(F.col("id").alias("dedupe_key"), (F.col("stated_total") * 2).cast("decimal(14,2)").alias("amount"), F.lit("OPEN").alias("status"))
    return K.upsert_keep_decision(stored, fresh, decisions=("status",))


@query("proposal", sql="select id, case when status = 'PENDING' and row_number() over (partition by entity_type, entity_id, field_name, status = 'PENDING' order by created_at desc, id desc) > 1 then 'SUPERSEDED' else status end as status from proposal")
def supersede_pending(v):
    return K.supersede_pending(v("proposal")).select("id", "status")


@query("proposal", sql="select id, case when status = 'PENDING' and created_at < timestamp '2024-01-31' - interval 14 day then 'REJECTED' else status end as status, case when status = 'PENDING' and created_at < timestamp '2024-01-31' - interval 14 day then 'stale: pending over 14 days' end as reason from proposal")
def dismiss_stale(v):
    return K.dismiss_stale(v("proposal"), now="2024-01-31").select("id", "status", "reason")


_EVENTS = """, ev as (select case when id % 9 <> 0 then project_hint end as project_id, sent_at as at, 'message' as kind from message union all select entity_id, created_at, 'proposal' from proposal where entity_type = 'project')"""


@query("message", "proposal", sql=_EVENTS + """, w as (select project_id, kind, count(case when cast(ev.at as date) > date '2024-01-14' - 7 and cast(ev.at as date) <= date '2024-01-14' then 1 end) as now, count(case when cast(ev.at as date) > date '2024-01-14' - 14 and cast(ev.at as date) <= date '2024-01-14' - 7 then 1 end) as before from ev where cast(ev.at as date) > date '2024-01-14' - 14 and cast(ev.at as date) <= date '2024-01-14' group by 1, 2) select *, now - before as change from w""")
def weekly_changes(v):
    m = v("message").select(F.when(F.col("id") % 9 != 0, F.col("project_hint")).alias("project_id"), F.col("sent_at").alias("at"), F.lit("message").alias("kind"))
    p = v("proposal").filter("entity_type = 'project'").select(F.col("entity_id").alias("project_id"), F.col("created_at").alias("at"), F.lit("proposal").alias("kind"))
    return K.weekly_changes(m.unionByName(p), now="2024-01-14")


def _resolved(v):
    keys = v("receipt").filter("job_name is not null").select(F.col("job_name").alias("key")).distinct()
    return J.exact_match(keys.withColumn("name", F.col("key")), v("project"), ["name"]).withColumn("method", F.lit("job_name"))


_RELINK = """, rl as (select r.*, case when match_method = 'manual' then r.project_id else p.id end as new_project_id, case when match_method = 'manual' then 'manual' when p.id is not null then 'job_name' else 'unresolved' end as new_method from receipt r left join project p on p.name = r.job_name)
"""


@query("receipt", "project", sql=_RELINK + "select id, new_project_id, new_method, new_project_id is distinct from project_id as changed from rl")
def relink(v):
    return K.relink(v("receipt"), _resolved(v)).select("id", "new_project_id", "new_method", "changed")


@query("receipt", "project", sql=_RELINK + "select id, new_project_id as project_id, new_method as match_method, case when id % 8 = 0 then 'reviewed' else detail_status end as detail_status from rl")
def rebuild_all(v):
    decisions = v("receipt").filter("id % 8 = 0").select("id", F.lit("reviewed").alias("detail_status"))
    return K.rebuild_all(v("receipt"), _resolved(v), decisions)


@query("project", "document", "task", sql="""
select p.id as project_id, coalesce(d.n, 0) as documents, coalesce(t.n, 0) as tasks, case when p.id % 10 = 9 then '' else array_to_string(list_filter([case when coalesce(d.n, 0) = 0 then 'no-drive-folder' end, case when coalesce(d.n, 0) = 0 and coalesce(t.n, 0) = 0 then 'empty-record' end], lambda x: x is not null), ',') end as flags
from project p left join (select project_id, count(*) as n from document where not is_trashed group by 1) d on d.project_id = p.id left join (select project_id, count(*) as n from task group by 1) t on t.project_id = p.id""")
def project_doctor(v):
    return K.project_doctor(v("project"), v("document"), v("task"), v("project").filter("id % 10 = 9")).withColumn("flags", F.array_join("flags", ","))


@query("document", sql="select coalesce(category, '(none)') as category, count(*) as documents, count(case when project_id is null and category is null then 1 end) as orphans from (select case when id % 4 <> 0 then project_id end as project_id, case when id % 6 <> 0 then string_split(folder_path, '/')[-1] end as category from document) group by 1")
def orphan_documents(v):
    docs = v("document").select(F.when(F.col("id") % 4 != 0, F.col("project_id")).alias("project_id"), F.when(F.col("id") % 6 != 0, F.element_at(F.split("folder_path", "/"), -1)).alias("category"))
    return K.orphan_documents(docs)


@query("ledger", sql="select project_id, count(*) as n from ledger where side = 'cost' and cost_status is null group by 1")
def cost_status_audit(v):
    return K.cost_status_audit(v("ledger"))


@query("task", sql="select project_id, count(*) as n from task where status = 'DONE' and id % 2 = 0 group by 1")
def done_undated(v):
    return K.done_undated(v("task").withColumn("completed_at", F.when(F.col("id") % 2 != 0, F.col("start_date"))))


@query("document", sql="select count(*) as n, count(case when id % 50 <> 0 then 1 end) as outside, count(case when id % 50 <> 0 then 1 end) >= count(*) * 0.9 as misconfigured from document")
def path_containment(v):
    return K.path_containment(v("document").withColumn("folder_path", F.when(F.col("id") % 50 == 0, F.concat(F.lit("01. "), "folder_path")).otherwise(F.col("folder_path"))), pattern=r"^\d{2}\. ")


@query("project", sql="select (100 + id % 400)::varchar as civic, count(*) as projects from project group by 1 having count(*) > 1")
def civic_duplicates(v):
    return K.civic_duplicates(v("project").withColumn("name", F.concat((100 + F.col("id") % 400).cast("string"), F.lit(" "), "name")))


@query("document", "project", "ledger", "task", sql="""
, f as (select 'mislinked' as c, 'warn' as l, d.id::varchar as s from document d join project p on p.id = d.project_id where not list_contains(string_split(folder_path, '/'), p.name) union all select 'cost_without_status', 'warn', project_id::varchar from (select project_id from ledger where side = 'cost' and cost_status is null group by 1)
 union all select 'done_undated', 'info', project_id::varchar from (select project_id from task where status = 'DONE' and id % 2 = 0 group by 1))
select c as check, l as level, count(*) as n, min(s) as sample from f group by 1, 2 union all select 'duplicate_projects', 'ok', 0, null""")
def data_doctor(v):
    return K.data_doctor({
        "mislinked": ("warn", J.mislinked_documents(v("document"), v("project")), "id"), "cost_without_status": ("warn", K.cost_status_audit(v("ledger")), "project_id"),
        "done_undated": ("info", K.done_undated(v("task").withColumn("completed_at", F.when(F.col("id") % 2 != 0, F.col("start_date")))), "project_id"), "duplicate_projects": ("error", A.duplicate_keys(v("project"), "id"), "id"),
    })


@query("project", "document", "task", "proposal", sql="""
, d as (select project_id, count(*) as documents from document where not is_trashed group by 1), t as (select project_id, count(*) as tasks from task group by 1), q as (select entity_id, count(*) as n from proposal where status = 'PENDING' and entity_type = 'project' group by 1)
select p.id as project_id, coalesce(documents, 0) as documents, coalesce(tasks, 0) as tasks, coalesce(q.n, 0) as pending, p.budget < 0 as budget_flagged from project p left join d on d.project_id = p.id left join t on t.project_id = p.id left join q on q.entity_id = p.id""")
def daily_review(v):
    pending = v("proposal").filter("status = 'PENDING' and entity_type = 'project'").withColumnRenamed("entity_id", "project_id")
    budget = v("project").select(F.col("id").alias("project_id"), (F.col("budget") < 0).alias("flagged"))
    return K.daily_review(A.project_overview(v("project"), v("document"), v("task")), pending, budget).select("project_id", "documents", "tasks", "pending", "budget_flagged")


@query("bid", "budget", "ledger", sql="""
, g as (select coalesce(b.division_code, q.division_code) as d, q.n, b.amount from (select division_code, sum(budget_amount) as amount from budget group by 1) b full join (select division_code, count(*) as n from bid group by 1) q using (division_code)),
k as (select d from g union select division_code from ledger where side = 'cost')
select 'green_sheet' as section, k.d as key, coalesce(n, 0) as n, amount::double as amount from k left join g on g.d = k.d union all select 'bids', status, count(*), sum(amount)::double from bid group by 2 union all select 'scope', division_code, count(*), null from budget group by 2 union all select 'provenance', 'live', (select count(*) from k), null""")
def finance_home(v):
    return K.finance_home(A.green_sheet(v("ledger"), v("bid"), v("budget")), v("bid"), v("budget"), source="live")


@query("proposal", "project", sql="select p.id, p.field_name, q.name as label from proposal p left join project q on q.id = p.entity_id and p.entity_type = 'project' where p.status = 'PENDING' order by created_at desc, p.id limit 100")
def proposals_list(v):
    p = v("proposal")
    labels = p.filter("entity_type = 'project'").select("id", F.col("entity_id").alias("pid")).join(v("project").select(F.col("id").alias("pid"), F.col("name").alias("label")), "pid").select("id", "label")
    return S.proposals_list(p, labels, status="PENDING").select("id", "field_name", "label")


@query("proposal", "document", sql="select d.id as document_id, p.id as proposal_id from proposal p join document d on d.id = p.entity_id or d.id = p.entity_id + 7 where p.entity_id is not null")
def citing_proposals(v):
    p = v("proposal").withColumn("evidence", F.to_json(F.array("entity_id", F.col("entity_id") + 7, "entity_id")))
    return S.citing_proposals(p, v("document")).select("document_id", "proposal_id")

