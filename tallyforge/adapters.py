"""Canonical views over the driver's tables.

Each view is one SELECT in the SQL that Spark and DuckDB share, so a query and its
oracle start from the same rows. ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .scratch import shuffled

TODAY = "1998-06-01"

VIEWS = {
    "project": """
select c_custkey as id, c_name as name, concat('J', cast(c_custkey as string)) as code, cast(c_nationkey as bigint) as client_id,
  case c_mktsegment when 'BUILDING' then 'ACTIVE' when 'MACHINERY' then 'PROPOSED' when 'FURNITURE' then 'ON_HOLD' when 'HOUSEHOLD' then 'CANCELLED' else 'COMPLETED' end as status,
  cast(c_acctbal as decimal(14,2)) as budget from {customer}""",
    "document": """
select o_orderkey as id, o_custkey as project_id, cast(o_orderdate as date) as modified,
  case substr(o_orderpriority, 1, 1) when '1' then 'invoice' when '2' then 'receipt' when '3' then 'quote' when '4' then 'estimate' else 'change_order' end as doc_role,
  o_orderkey % 17 = 0 as is_trashed, cast(o_totalprice as decimal(14,2)) as stated_total,
  concat(case o_orderkey % 6 when 0 then 'Cost tracker ' when 1 then 'Contract ' when 2 then 'Invoice ' when 3 then 'ACCEPTED QUOTE ' when 4 then 'Lease ' else 'Site photo ' end, cast(o_orderkey as string)) as name,
  case o_orderkey % 4 when 0 then 'application/pdf' when 1 then 'text/csv' when 2 then 'image/jpeg' else 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end as mime_type,
  concat('Projects/Customer#', lpad(cast(case when o_orderkey % 13 = 0 then o_custkey + 1 else o_custkey end as string), 9, '0'), '/', case o_orderkey % 3 when 0 then 'Contracts' when 1 then 'Invoices' else 'Photos' end) as folder_path,
  case when o_orderkey % 9 = 0 then null when o_orderkey % 9 = 1 then '' else concat('Paid $', cast(o_orderkey % 1000 as string), '.50 of $', cast(o_custkey as string), ',000.00 by wire') end as body
from {orders}""",
    "financial_record": """
select l_orderkey as document_id, o_custkey as project_id,
  case l_returnflag when 'N' then 'client_in' when 'A' then 'contractor_out' else 'unknown' end as direction,
  case l_linenumber when 1 then 'total' when 2 then 'tax' when 3 then 'deposit' else 'line_item' end as record_kind,
  cast(l_extendedprice as decimal(14,2)) as amount, l_orderkey % 11 = 0 as is_rollup,
  case substr(o_orderpriority, 1, 1) when '1' then 'invoice' when '2' then 'receipt' when '3' then 'quote' when '4' then 'estimate' else 'change_order' end as doc_role,
  l_discount * 10 as confidence, l_partkey as line_key
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "ledger": """
select o_custkey as project_id, l_orderkey as document_id, l_linestatus as unit, p_brand as division_code,
  case l_returnflag when 'N' then 'revenue' else 'cost' end as side,
  case l_linenumber when 1 then 'total' when 2 then 'tax' when 3 then 'material' when 4 then 'labour' when 5 then 'adjustment' else 'material' end as amount_type,
  cast(l_extendedprice as decimal(14,2)) as amount,
  case o_orderstatus when 'F' then 'accepted' when 'O' then 'proposed' else 'superseded' end as status,
  case l_suppkey % 5 when 0 then null when 1 then 'actual' when 2 then 'quoted' when 3 then 'committed' else 'unknown' end as cost_status,
  l_suppkey as bid_id
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey""",
    "bid": """
select s_suppkey as id, s_name as vendor, cast(s_nationkey as bigint) as package_id, concat('Brand#', cast(s_suppkey % 6 as string)) as division_code,
  case s_suppkey % 4 when 0 then 'pending' when 1 then 'recommended' when 2 then 'selected' else 'rejected' end as status,
  cast(s_acctbal as decimal(14,2)) as amount from {supplier}""",
    "budget": """
select p_brand as division_code, p_size % 3 as snapshot_id, cast(sum(cast(p_retailprice as decimal(14,2))) as decimal(18,2)) as budget_amount from {part} group by p_brand, p_size % 3""",
    "obligation": """
select o_orderkey as id, o_custkey as project_id, case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) + interval '60' day end as due_at,
  case o_orderstatus when 'F' then 'owed_to_us' when 'O' then 'owed_by_us' else 'internal' end as direction,
  case when o_orderkey % 10 = 0 then 'on completion' else null end as trigger, cast(o_totalprice as decimal(14,2)) as amount
from {orders}""",
    "task": """
select l_orderkey as project_id, l_linenumber as id, concat('Task ', cast(l_linenumber as string), ' of ', cast(l_orderkey as string)) as title,
  cast(min(l_shipdate) as date) as start_date, cast(max(l_quantity) as int) as duration,
  case (l_orderkey + l_linenumber) % 5 when 0 then 'DONE' when 1 then 'IN_PROGRESS' when 2 then 'BLOCKED' when 3 then 'CANCELLED' else 'TODO' end as status
from {lineitem} group by l_orderkey, l_linenumber""",
    "edge": """
select s.project_id, p.id as predecessor_id, s.id as successor_id from {task} p join {task} s on p.project_id = s.project_id and (s.id = p.id + 1 or s.id = p.id * 2)""",
    "receipt": """
select o_orderkey as id, o_orderkey % 2 = 1 as online, case when o_orderkey % 7 = 0 then null else o_custkey end as project_id, cast(o_orderdate as date) as sales_date,
  cast(case when o_orderkey % 23 = 0 then -o_totalprice else o_totalprice end as decimal(14,2)) as total,
  cast(floor(o_totalprice * 87) / 100 as decimal(14,2)) as subtotal, o_orderkey % 23 = 0 as is_refund,
  case o_orderkey % 4 when 0 then 'imported' when 1 then 'pending' when 2 then 'unbalanced' else 'pending' end as detail_status,
  case when o_orderkey % 31 = 0 then o_orderkey - 1 else null end as duplicate_of,
  case o_orderkey % 5 when 0 then concat('Customer#', lpad(cast(o_custkey as string), 9, '0')) when 1 then concat('j', cast(o_custkey as string), ' - gift') when 2 then 'ONLINE ORDER' when 3 then concat('JOB j', cast(o_custkey as string)) else null end as job_name,
  case when o_orderkey % 6 = 0 then 'manual' else 'auto' end as match_method
from {orders}""",
    "receipt_line": """
select l_orderkey as receipt_id, l_linenumber as line_number, case when l_partkey % 10 = 0 then null else concat('SKU', cast(l_partkey as string)) end as sku, p_name as product_name,
  cast(l_quantity as decimal(12,3)) as quantity, cast(l_extendedprice as decimal(14,2)) as subtotal, l_partkey as part_key
from {lineitem} join {part} on l_partkey = p_partkey""",
    "message": """
select event_id as id, user_id as sender, ts as sent_at, event_type as channel, value, cast(user_id % 20 as bigint) as project_hint, props from {events}""",
    "claim": """
select event_id as id, case event_type when 'click' then 'gmail' when 'view' then 'telegram' else 'form' end as source_channel,
  case when user_id % 10 = 0 then null else user_id end as worker_id, concat('Worker ', cast(user_id as string)) as employee_name_raw,
  case when event_id % 19 = 0 then null else cast(user_id % 20 as bigint) end as project_id, case when event_id % 29 = 0 then null else cast(ts as date) end as work_date,
  case when event_id % 3 = 0 then null else '07:00' end as time_arrived, case when event_id % 4 = 0 then null else '16:00' end as time_left,
  case when event_id % 5 = 0 then null else cast(value % 12 as decimal(6,2)) end as total_hours_reported, case when event_id % 7 = 0 then null else cast((value + 1) % 12 as decimal(6,2)) end as total_hours_computed,
  event_id % 11 = 0 as hours_mismatch, (event_id % 10) / 10.0 as source_confidence,
  case event_id % 6 when 0 then 'correction' when 1 then 'attendance_only' else 'labour_time' end as claim_type, case when event_id % 13 = 0 then 'needs_review' else 'pending' end as review_status
from {events}""",
    "proposal": """
select event_id as id, case event_id % 3 when 0 then 'project' else 'task' end as entity_type, case event_id % 3 when 0 then user_id else event_id % 500 end as entity_id,
  case event_type when 'click' then 'end_date' when 'view' then 'start_date' else 'scope_gap' end as field_name, ts as created_at,
  case event_id % 4 when 0 then 'PENDING' when 1 then 'ACCEPTED' when 2 then 'REJECTED' else 'PENDING' end as status, props, value as confidence
from {events}""",
    "text": "select doc_id as document_id, text, lang, source from {documents}",
    "vector": "select vec_id as id, embedding, label from {embeddings}",
}

#: Views of about as many rows as the largest table, which other views join to themselves.
LARGE = {"task"}
_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view, or a driver table where no view has the name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    parts = {n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(VIEWS[name]))}
    parts = {n: shuffled(df) if n in LARGE else df for n, df in parts.items()}
    return spark.sql(VIEWS[name], **parts)


def with_views(*names: str) -> str:
    """The WITH clause that defines views in an oracle."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _NAME.findall(VIEWS[name]):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    return "with recursive " + ", ".join(f"{n} as ({_NAME.sub(lambda m: m[1], VIEWS[n]).strip()})" for n in order) + "\n"
