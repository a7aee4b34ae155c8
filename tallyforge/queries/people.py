"""Hours and claims over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import labour as B
from .registry import query

_KEY = "case when worker_id is not null then concat('w:', worker_id) else concat('n:', lower(trim(employee_name_raw))) end"
_FLAGS = """list_filter([case when claim_type not in ('labour_time', 'attendance_only') then concat('claim_type:', claim_type) end, case when review_status = 'needs_review' then 'claim_needs_review' end, case when source_confidence < 0.5 then 'low_confidence' end, case when hours_mismatch then 'hours_mismatch' end,
 case when worker_id is null then 'unresolved_worker' end, case when project_id is null then 'unresolved_project' end, case when work_date is null then 'missing_date' end, case when total_hours_reported is null and total_hours_computed is null and (time_arrived is null or time_left is null) then 'missing_hours' end], lambda x: x is not null)"""
_CLUSTERS = f""", k as (select *, case when work_date is null then concat('claim:', id) else concat({_KEY}, '|', work_date) end as cluster_key, {_KEY} as worker_key, len(list_filter({_FLAGS}, lambda f: f <> 'low_confidence')) > 0 as hard from claim),
g as (select project_id, cluster_key, max(worker_id) as worker_id, max(worker_key) as worker_key, max(work_date) as work_date, count(*) as members, count(distinct source_channel) as channels, coalesce(max(total_hours_reported) - min(total_hours_reported) > 0.25, false) as conflict, bool_or(hard) as hard, bool_or(work_date is null) as dateless,
 first({{'id': id, 'h': coalesce(total_hours_reported, total_hours_computed)}} order by (time_arrived is not null)::int + (time_left is not null)::int + (total_hours_reported is not null)::int desc, source_channel = 'gmail' desc, id) as c from k group by 1, 2),
cl as (select project_id, cluster_key, worker_key, work_date, members, channels, case when dateless then 'needs_review' when conflict then 'conflict' when worker_id is null or hard then 'needs_review' when channels >= 2 then 'auto_reinforced' else 'auto_single_source' end as status,
 50 + case when worker_id is not null then 20 else 0 end + case when channels >= 2 and not conflict then 20 else 0 end + case when not conflict and not dateless then 10 else 0 end as points, c.id as chosen_id, c.h as hours from g)
"""


@query("claim", sql=f"select {_KEY} as worker_key, count(*) as entries, count(distinct work_date) as days, coalesce(sum(total_hours_reported), 0)::double as reported, coalesce(sum(total_hours_computed), 0)::double as computed, count(case when hours_mismatch then 1 end) as mismatches, min(work_date) as first_day, max(work_date) as last_day from claim group by 1")
def labour_hours(v):
    return A.labour_hours(v("claim"))


@query("claim", sql=_CLUSTERS + "select project_id, cluster_key, worker_key, work_date, members, channels, status, (case when status in ('conflict', 'needs_review') then least(points, 40) else points end / 100)::double as confidence, chosen_id, hours::double as hours from cl")
def consolidate_claims(v):
    return B.consolidate_claims(v("claim"))


@query("claim", sql=_CLUSTERS + "select worker_key, count(*) as shifts, coalesce(sum(hours), 0)::double as hours, count(distinct work_date) as days from cl where status in ('auto_reinforced', 'auto_single_source') group by 1")
def labour_roster(v):
    return A.labour_roster(B.consolidate_claims(v("claim")))


@query("claim", sql=f"select id, array_to_string({_FLAGS}, ',') as flags from claim")
def claim_flags(v):
    return v("claim").select("id", F.array_join(B.claim_flags(), ",").alias("flags"))


@query("claim", sql="select sha256(concat('gmail/', id)) as claim_id, sha256(concat('email_project_log/', 'm', id % 50)) as source_event_id, worker_id, case when total_hours_reported is not null then 'labour_time' else 'attendance_only' end as claim_type from claim where source_channel = 'gmail'")
def bridge_claims(v):
    entries = v("claim").filter("source_channel = 'gmail'").withColumn("submission_id", F.col("id") % 50)
    submissions = v("claim").select((F.col("id") % 50).alias("id")).distinct().select("id", F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.lit("2024-01-01").cast("timestamp").alias("received_at"))
    return B.bridge_claims(entries, submissions).select("claim_id", "source_event_id", "worker_id", "claim_type")
