"""Sources and sinks: text, JSON and files that Spark writes from the driver's tables, then reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import TODAY
from ..operators import aggregates as A
from ..plans import registry as P
from ..scratch import Scratch
from ..sources import readers as R
from .registry import query


@query("document", sql="select id, project_id, doc_role from document where not is_trashed")
def scan_table(v):
    scratch = Scratch(v.spark)
    scratch.keep(v("document").select("id", "project_id", "doc_role", "is_trashed"), "table")
    return R.scan_table(v.spark, scratch.path("table")).select("id", "project_id", "doc_role")


@query("project", sql="select name as client, code, budget::varchar as budget, 1.0::double as confidence from project")
def scan_delimited(v):
    scratch = Scratch(v.spark)
    rows = v("project").select("id", "name", "code", F.col("budget").cast("string").alias("budget"))
    for k, sep in enumerate((",", "\t")):
        lines = rows.filter(F.col("id") % 2 == k).select(F.concat_ws(sep, "name", "code", "budget").alias("value"))
        head = v.spark.range(1).select(F.lit(sep.join(("Client", "Code", "Budget"))).alias("value"))
        head.unionByName(lines).coalesce(1).write.text(f"{scratch.path('files')}/part={k}")
    found = R.scan_delimited(v.spark, f"{scratch.path('files')}/*/*.txt")
    return found.select(F.get("cells", 0).alias("client"), F.get("cells", 1).alias("code"), F.get("cells", 2).alias("budget"), "confidence")


def _raw_headers(v):
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    r = v("receipt")
    total = F.when(F.col("total") < 0, F.concat(F.lit("("), money(F.abs("total")), F.lit(")"))).otherwise(money(F.col("total")))
    return r.select(F.col("id").cast("string").alias(" Transaction Number"), F.date_format("sales_date", "dd/MM/yyyy").alias("Sales Date"), F.col("job_name").alias("Job Name"), money(F.col("subtotal")).alias("Subtotal"), total.alias("Total "))


@query("receipt", sql="select id::varchar as number, sales_date, trim(job_name) as job_name, subtotal::double as subtotal, total::double as total, (total - subtotal)::double as tax, total < 0 as is_refund from receipt")
def import_purchase_headers(v):
    return R.import_purchase_headers(_raw_headers(v))


@query("receipt", "receipt_line", sql="select coalesce(r.id, l.receipt_id)::varchar as number, s::double as line_sum, r.id is null as is_stub from (select * from receipt where id % 6 <> 0) r full join (select receipt_id, sum(subtotal) as s from receipt_line group by 1) l on l.receipt_id = r.id")
def import_purchase_lines(v):
    lines = v("receipt_line").select(F.col("receipt_id").cast("string").alias("Transaction Number"), F.col("part_key").alias("Line Order"), F.col("sku").alias("SKU Number"), F.col("product_name").alias("Product Name"), F.col("quantity").cast("string").alias("Quantity"), F.concat(F.lit("$"), F.format_number("subtotal", 2)).alias("Subtotal"))
    headers = R.import_purchase_headers(_raw_headers(v)).filter(F.col("number").cast("long") % 6 != 0)
    return R.import_purchase_lines(lines, headers)[1].select("number", "line_sum", "is_stub")


def _boards(v):
    """One JSON list of items per customer; an order is an item, its lines subitems."""
    cell = lambda i, kind, text, value: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type"), text.alias("text"), value.alias("value"))
    none = F.lit(None).cast("string")
    d = v("document")
    label = F.when(F.col("id") % 3 == 0, "Done").when(F.col("id") % 3 == 1, "Stuck").otherwise("Working on it")
    line = F.to_json(F.struct(F.date_format("modified", "yyyy-MM-dd").alias("from"), F.date_format(F.date_add("modified", 9), "yyyy-MM-dd").alias("to")))
    cols = F.array(cell("Status", "status", label, none), cell("Timeline", "timeline", none, line), cell("Budget", "numbers", F.concat(F.lit("$"), F.format_number("stated_total", 2)), none), cell("Owner", "people", F.concat(F.lit("U"), (F.col("id") % 5).cast("string")), none))
    subs = F.array(F.struct(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit("part").alias("name"), F.array(cell("Status", "status", F.lit("Done"), none)).alias("column_values")))
    item = F.struct(F.col("id").cast("string").alias("id"), F.col("name"), F.struct(F.col("doc_role").alias("title")).alias("group"), cols.alias("column_values"), subs.alias("subitems"))
    return d.groupBy("project_id").agg(F.to_json(F.collect_list(item)).alias("json"))


@query("document", sql="""select id::varchar as item_id, null as parent_id, c as "column", doc_role as "group" from document, (values ('Status'), ('Timeline'), ('Budget'), ('Owner')) t(c) union all select concat('s', id), id::varchar, 'Status', doc_role from document""")
def read_board_items(v):
    return R.read_board_items(_boards(v)).select("item_id", "parent_id", "column", "group")


@query("document", sql="select id::varchar as item_id, case id % 3 when 0 then 'DONE' when 1 then 'BLOCKED' else 'IN_PROGRESS' end as status, modified as start_date, (modified + interval 9 day)::date as end_date, stated_total::double as budget, concat('U', id % 5) as people from document union all select concat('s', id), 'DONE', null, null, null, null from document")
def map_board_columns(v):
    return R.map_board_columns(R.read_board_items(_boards(v))).select("item_id", "status", "start_date", "end_date", "budget", "people")


@query("document", sql="select id, case when id % 4 = 0 then least('MIRROR', doc_role) else doc_role end as status, case when id % 4 = 0 then date '2020-01-01' else modified end as start_date from document")
def mirror_overlay(v):
    tasks = v("document").select("id", F.col("doc_role").alias("status"), F.col("modified").alias("start_date"), F.col("modified").alias("end_date"))
    mirrors = v("document").filter("id % 4 = 0").select(F.array("id", F.col("id") + 100_000_000).alias("task_ids"), F.lit("MIRROR").alias("status"), F.lit("2020-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return R.mirror_overlay(tasks, mirrors).select("id", "status", "start_date")


@query("document", "project", sql=f"""select d.id::varchar as id, case when d.id % 2 = 0 then 'invoice' else 'estimate' end as kind, stated_total::double as amount, (modified + interval 30 day)::date as due_date,
 case when d.id % 2 = 0 then case when d.id % 8 = 0 then 'PAID' when d.id % 8 = 2 then 'PARTIAL' when (modified + interval 30 day)::date < date '{TODAY}' then 'OVERDUE' else 'SENT' end else case when d.id % 3 = 0 then 'WON' when d.id % 3 = 1 then 'LOST' else 'PROPOSAL' end end as status, p.id as project_id from document d left join project p on p.id = d.project_id and d.id % 5 <> 0""")
def map_accounting_docs(v):
    d = v("document")
    balance = F.when(F.col("id") % 8 == 0, 0.0).when(F.col("id") % 8 == 2, F.col("stated_total").cast("double") / 2).otherwise(F.col("stated_total").cast("double"))
    body = F.struct(
        F.col("id").cast("string").alias("Id"), F.col("stated_total").cast("double").alias("TotalAmt"), balance.alias("Balance"), F.date_format(F.date_add("modified", 30), "yyyy-MM-dd").alias("DueDate"), F.when(F.col("id") % 3 == 0, "Accepted").when(F.col("id") % 3 == 1, "Rejected").otherwise("Pending").alias("TxnStatus"),
        F.struct(F.col("project_id").cast("string").alias("value")).alias("CustomerRef"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("job j"), F.col("project_id").cast("string"), F.lit(" / deposit"))).alias("PrivateNote"),
    )
    docs = d.select(F.when(F.col("id") % 2 == 0, "invoice").otherwise("estimate").alias("kind"), F.to_json(body).alias("json"))
    return R.map_accounting_docs(docs, v("project"), today=TODAY).select("id", "kind", "amount", "due_date", "status", "project_id")


def _files(v, scratch):
    """A text file tree: one folder per nation and language of documents."""
    docs = v("documents").select((F.col("doc_id") % 5).alias("shelf"), "lang", "text")
    docs.select("shelf", "lang", F.regexp_replace("text", "\n", " ").alias("value")).repartition(4, "shelf", "lang").write.partitionBy("shelf", "lang").text(scratch.path("Invoices"))
    return scratch.path("Invoices")


@query(sql="select concat('shelf=', doc_id % 5) as bucket, count(distinct lang) as folders, 'invoice' as category from documents group by 1")
def document_catalog(v):
    path = _files(v, Scratch(v.spark))
    found = R.document_catalog(v.spark, path).filter("name like '%.txt'")
    return found.groupBy("bucket", "category").agg(F.countDistinct("folder").alias("folders"))


@query(sql="select doc_id as id, case when doc_id % 7 = 0 then 'skipped-trashed' when doc_id % 3 = 0 then 'skipped-mime' when doc_id % 5 = 0 then 'csv' else 'plain' end as method, case when not (doc_id % 7 = 0 or doc_id % 3 = 0) then md5(text) end as digest from documents")
def extract_corpus_text(v):
    mime = F.when(F.col("doc_id") % 3 == 0, "image/png").when(F.col("doc_id") % 5 == 0, "text/csv").otherwise("text/plain")
    files = v("documents").select(F.col("doc_id").alias("id"), mime.alias("mime_type"), (F.col("doc_id") % 7 == 0).alias("is_trashed"), F.octet_length("text").alias("bytes"), F.encode("text", "UTF-8").alias("content"))
    return R.extract_corpus_text(files).select("id", "method", F.md5("text").alias("digest"))


@query("document", sql="select project_id as document_id, id as parse_id, id % 3 as page from document where id % 4 <> 0 qualify row_number() over (partition by project_id order by modified desc, id desc) = 1")
def document_regions(v):
    d = v("document")
    parses = d.select(F.col("project_id").alias("document_id"), F.col("id").alias("parse_id"), F.col("modified").alias("created_at"), (F.col("id") % 4 != 0).alias("ok"))
    spans = d.select(F.col("id").alias("parse_id"), F.lit("table").alias("kind"), F.struct((F.col("id") % 3).alias("page")).alias("locator"), F.substring("body", 1, 40).alias("preview"), F.lit(0.9).alias("confidence"))
    return R.document_regions(parses, spans).select("document_id", "parse_id", F.col("locator.page").alias("page"))


@query("claim", sql="select concat('Site ', project_id) as project, count(*) as n from claim where project_id is not null group by 1")
def export_work_log(v):
    scratch = Scratch(v.spark)
    entries = v("claim").filter("project_id is not null").select(F.concat(F.lit("Site "), F.col("project_id").cast("string")).alias("project_name"), "work_date", F.col("employee_name_raw").alias("name"), "total_hours_reported")
    R.export_work_log(entries, scratch.path("log"))
    back = v.spark.read.option("header", "true").option("basePath", scratch.path("log")).csv(scratch.path("log"))
    return back.groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query("document", "financial_record", sql="select project_id, count(distinct id) as documents, sum(n)::bigint as records from (select d.project_id, d.id, count(f.document_id) as n from document d left join financial_record f on f.document_id = d.id where not is_trashed group by 1, 2) group by 1")
def export_project_bundles(v):
    scratch = Scratch(v.spark)
    R.export_project_bundles(v("document"), v("financial_record"), scratch.path("bundles"))
    back = v.spark.read.schema("project_id long, documents array<struct<id:long,records:array<struct<record_kind:string>>>>").json(scratch.path("bundles"))
    return back.select("project_id", F.size("documents").cast("long").alias("documents"), F.aggregate("documents", F.lit(0).cast("long"), lambda s, d: s + F.size(d["records"])).alias("records"))


@query("receipt_line", sql="""select receipt_id as project_id, case when part_key % 3 = 0 then '10-12' else '09' end as division_code, count(*) as items from receipt_line where part_key % 3 <> 1 group by 1, 2""")
def import_scope_sheet(v):
    code = F.when(F.col("part_key") % 3 == 0, "1012").when(F.col("part_key") % 3 == 1, "1").otherwise("9")
    rows = v("receipt_line").select(F.col("receipt_id").alias("project_id"), F.col("part_key").alias("item_id"), code.alias("csi_div_code"), F.col("product_name").alias("trade"), F.col("product_name").alias("description"), F.when(F.col("part_key") % 2 == 0, "n").otherwise("Y").alias("included"))
    return R.import_scope_sheet(rows)[0].select("project_id", "division_code", "items")


@query(sql="select case p_size % 3 when 0 then 'plan' when 1 then 'build' else 'close' end as phase, p_partkey as ordinal, case when p_partkey % 2 = 0 then p_name else 'stored' end as title, case when p_partkey % 2 = 0 then 2 else 1 end as subtasks from part")
def import_template_tasks(v):
    phase = F.when(F.col("p_size") % 3 == 0, "plan").when(F.col("p_size") % 3 == 1, "build").otherwise("close")
    part = v("part").select(phase.alias("phase"), F.col("p_partkey").alias("ordinal"), "p_name")
    fresh = part.filter("ordinal % 2 = 0").select("phase", "ordinal", F.col("p_name").alias("title"), F.lit("measure; ;cut\n").alias("subtasks"))
    stored = part.select("phase", "ordinal", F.lit("stored").alias("title"), F.array(F.lit("old")).alias("subtask_list"))
    return R.import_template_tasks(fresh, stored, phases=("plan", "build", "close")).select("phase", "ordinal", "title", F.size("subtask_list").alias("subtasks"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(sql=" union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in _TABLES))
def table_catalog(v):
    return A.table_counts({t: v(t) for t in _TABLES})


@query(sql="select o_orderkey, (select count(*) from orders) as total_rows from orders order by o_orderkey limit 20")
def table_preview(v):
    return R.table_preview(v("orders").select("o_orderkey"), n=20, order=("o_orderkey",))


@query("document", "project", sql="select d.id, case when mime_type = 'text/csv' then 100 else 0 end + case when regexp_matches(d.name, '(?i)quote|invoice|contract|budget|cost') then 40 else 0 end + case when regexp_matches(folder_path, '(?i)quote|invoice|contract|budget|cost') then 15 else 0 end + 5 + case when p.status = 'ACTIVE' then 20 else 0 end as score from document d left join project p on p.id = d.project_id where not is_trashed")
def parse_priority(v):
    return R.parse_priority(v("document"), v("project"))


@query("message", "project", sql="select p.id as key, p.id as target from project p")
def register_matcher(v):
    """A matcher of one's own, by its name in the registry."""
    P.register_matcher("same_name", lambda left, right: left.select(F.col("id").alias("key"), F.lower("name").alias("n")).join(right.select(F.col("id").alias("target"), F.lower("name").alias("n")), "n").select("key", "target"))
    return P.match("same_name", v("project").withColumn("name", F.upper("name")), v("project"))


@query(sql="select doc_id as id, case when doc_id % 2 = 0 then 'shout' else 'plain' end as method, md5(case when doc_id % 2 = 0 then replace(text, 'e', 'E') else text end) as digest from documents")
def register_extractor(v):
    R.register_extractor("text/shout", lambda b: (b.decode().replace("e", "E"), "shout"))
    files = v("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "text/shout").otherwise("text/plain").alias("mime_type"), F.lit(False).alias("is_trashed"), F.octet_length("text").alias("bytes"), F.encode("text", "UTF-8").alias("content"))
    return R.extract_corpus_text(files).select("id", "method", F.md5("text").alias("digest"))


@query("text", sql="select document_id, 3 as dims, length(text)::double as n_chars from text")
def register_embedder(v):
    import pandas as pd

    P.register_embedder("lengths", lambda texts: pd.Series([[float(len(t)), 1.0, 0.0] for t in texts]))
    e = P.embed("lengths", v("text"))
    return e.select("document_id", F.size("embedding").alias("dims"), F.get("embedding", 0).cast("double").alias("n_chars"))


@query("project", sql="select id, name, code from project where status = 'PROPOSED'")
def report_registry(v):
    from ..operators.filters import active_projects

    P.register_report("projects_by_status", active_projects)
    return P.run_report("projects_by_status", v("project"), status="PROPOSED")
