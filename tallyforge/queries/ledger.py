"""Ledger pipelines over the driver's tables: sheets are written from them as text, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..scratch import Scratch
from .registry import query


def quote_sheets(v):
    """One sheet per order, as a quote grid: each line a material and labour row below the section of its part's brand."""
    part = v("part").select(F.col("p_partkey").alias("part_key"), "p_brand")
    lines = v("receipt_line").join(part, "part_key").withColumn("division", F.when(F.col("p_brand") == "Brand#1", "Plumbing").when(F.col("p_brand") == "Brand#2", "Tiles").otherwise("Misc"))
    ordered = lines.groupBy("receipt_id", "division").agg(F.array_sort(F.collect_list(F.struct("line_number", "part_key", "subtotal", "product_name"))).alias("ls"), F.sum("subtotal").cast("decimal(18,2)").alias("total"))
    money = lambda c: F.concat(F.lit('"$'), F.format_number(c, 2), F.lit('"'))
    body = F.concat(F.col("division"), F.lit(",,,,"), money(F.col("total")), F.lit("\n"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("    "), x["product_name"], F.lit(",,"), money(x["subtotal"]), F.lit(",$1.00,"))), "\n"))
    text = F.concat(F.lit("ESTIMATE\nDescription,Notes,Material Amount (CAD),Labour Amount (CAD),Total Amount (CAD)\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("division", "body"))), lambda x: x["body"]), "\n"), F.lit('\n,Pre-Tax,,,"$'), F.format_number(F.sum("total"), 2), F.lit('"'))
    sheets = ordered.withColumn("body", body).groupBy("receipt_id").agg(text.alias("text"))
    sheets = Scratch(v.spark).keep(sheets, "sheets")
    return sheets.select(F.col("receipt_id").alias("document_id"), F.concat(F.lit("9"), F.lpad((F.col("receipt_id") % 100).cast("string"), 2, "0"), F.lit(" ACCEPTED QUOTE")).alias("name"), "text")


def extras_sheets(v):
    """One change order sheet per customer."""
    state = F.when(F.col("id") % 4 == 0, "Accepted").when(F.col("id") % 4 == 1, "Not Accepted").when(F.col("id") % 4 == 2, "Proposé").otherwise("")
    line = F.concat(F.col("id").cast("string"), F.lit("\tDoor work\t$5.00\t"), F.col("total").cast("string"), F.lit("\t"), state)
    rows = v("receipt").filter("project_id is not null").groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))), lambda x: x["t"]), "\n").alias("b"))
    return rows.select(F.col("project_id").alias("document_id"), F.concat(F.lit("Extras "), F.col("project_id").cast("string")).alias("name"), F.concat(F.lit("Client sheet\nCO #\tItem\tCost/Unit\tTotal\tStatus\n"), "b").alias("text"))


_LINES = """, li as (select receipt_id as document_id, case p_brand when 'Brand#1' then '22' when 'Brand#2' then '09' else '99' end as division_code, subtotal from receipt_line join part on p_partkey = part_key),
grid as (select document_id, 'line_item' as kind, division_code, 'material' as amount_type, subtotal as amount from li union all select document_id, 'line_item', division_code, 'labour', 1.00 from li
 union all select document_id, 'division_total', division_code, 'total', sum(subtotal) from li group by document_id, division_code union all select document_id, 'pre_tax', null, 'total', sum(subtotal) from li group by document_id)
"""


@query("receipt_line", sql=_LINES + "select document_id, kind, division_code, amount_type, count(*) as n, sum(amount)::double as amount from grid where kind <> 'pre_tax' group by 1, 2, 3, 4")
def parse_quote_grid(v):
    rows = L.parse_quote_grid(L.grid_lines(L.split_workbook_sections(quote_sheets(v)))).filter("kind <> 'pre_tax'")
    return rows.groupBy("document_id", "kind", "division_code", "amount_type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("receipt", sql="""select project_id as document_id, id::varchar as co_number, total::double as amount, case id % 4 when 0 then 'accepted' when 2 then 'proposed' else 'unknown' end as status, '08' as division_code from receipt where project_id is not null and id % 4 <> 1 and total <> 0""")
def parse_extras_grid(v):
    return L.parse_extras_grid(L.grid_lines(L.split_workbook_sections(extras_sheets(v)))).select("document_id", "co_number", "amount", "status", "division_code")


@query("receipt_line", "receipt", sql=_LINES + """, ex as (select project_id as document_id, count(*) as n, sum(total) as amount from receipt where project_id is not null and id % 4 <> 1 and total <> 0 group by 1)
select document_id + 10000000 as document_id, 'grid' as source, count(*) as n, sum(amount)::double as amount from grid where kind <> 'pre_tax' group by 1 union all select document_id, 'extras', n, amount::double from ex""")
def ledger_from_documents(v):
    docs = quote_sheets(v).withColumn("document_id", F.col("document_id") + 10_000_000).unionByName(extras_sheets(v))
    rows, _ = L.ledger_from_documents(docs)
    return rows.groupBy("document_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("document", sql="select id as document_id, 0 as position, null::varchar as sheet, coalesce(body, '') as body from document where id % 2 = 0 union all select id, p, case p when 0 then 'Quote A' else 'Extras' end, case p when 0 then 'one' else 'two' end from document, (values (0), (1)) t(p) where id % 2 = 1")
def split_workbook_sections(v):
    text = F.when(F.col("id") % 2 == 0, F.col("body")).otherwise("### Quote A\none\n### Extras\ntwo\n### (further sheets omitted -- workbook too large)\nthree")
    return L.split_workbook_sections(v("document").select(F.col("id").alias("document_id"), "name", text.alias("text"))).drop("name")


@query("financial_record", "document", sql="""
, s as (select document_id, sum(case when record_kind <> 'tax' then amount end) as net, sum(amount) as gross from financial_record group by 1), st as (select document_id, case when document_id % 3 = 0 then net when document_id % 3 = 1 then gross + 500 end as stated, document_id % 2 = 0 as shown from s),
j as (select s.document_id, case when stated is null then 'no_stated_total' when net is null then 'no_rows' when not (abs(net - stated) <= greatest(1, (abs(stated) * 0.01)::decimal(18,2)) or abs(gross - stated) <= greatest(1, (abs(stated) * 0.01)::decimal(18,2))) then 'sum_mismatch' when not shown then 'total_not_in_evidence' end as reason from s join st using (document_id))
select f.document_id, coalesce(reason, 'trusted') as verdict, count(*) as n from financial_record f join j using (document_id) where record_kind <> 'tax' group by 1, 2""")
def trust_gate(v):
    rows = v("financial_record").select("document_id", F.col("record_kind").alias("amount_type"), "amount", F.lit("work").alias("description"))
    net = F.sum(F.when(F.col("amount_type") != "tax", F.col("amount"))).cast("decimal(18,2)")
    sums = rows.groupBy("document_id").agg(net.alias("net"), F.sum("amount").cast("decimal(18,2)").alias("gross"))
    total = F.when(F.col("document_id") % 3 == 0, F.col("net")).when(F.col("document_id") % 3 == 1, (F.col("gross") + 500).cast("decimal(18,2)"))
    stated = sums.withColumn("stated_total", total).select("document_id", "stated_total", F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("Grand total: $"), F.format_number("stated_total", 2))).otherwise("nothing here").alias("text"))
    good, bad = L.trust_gate(rows, stated)
    return good.withColumn("reason", F.lit("trusted")).unionByName(bad).groupBy("document_id", F.col("reason").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("document", sql="""select id as document_id, id as item_id, (id % 1000 + 0.5)::double as amount, case when id % 4 = 0 then 'total' else 'other' end as record_kind, id % 4 <> 0 as kind_warning, coalesce(body, '') <> '' as verified, name like 'Cost tracker%' as is_rollup from document where id % 5 <> 0""")
def validate_records(v):
    d = v("document")
    text = F.when(F.col("id") % 5 == 0, "n/a").otherwise(F.concat(F.lit("CAD $"), (F.col("id") % 1000 + 0.5).cast("string")))
    items = d.select(F.col("id").alias("document_id"), F.col("id").alias("item_id"), text.alias("amount_text"), F.when(F.col("id") % 4 == 0, " Total").otherwise("misc").alias("record_kind"))
    return L.validate_records(items, d.select(F.col("id").alias("document_id"), "name", F.col("body").alias("text")))


@query("document", sql="""select id as document_id, case when id % 3 = 0 then 'ok' when coalesce(body, '') = '' and id % 4 = 2 then 'safe_skip' when coalesce(body, '') = '' then 'extract_text' when id % 3 = 1 and id % 4 = 0 then 'needs_extractor' when id % 3 = 1 then 'fix_layout' else 'safe_skip' end as action from document""")
def ledger_health(v):
    ext = F.when(F.col("id") % 4 == 0, ".PDF").when(F.col("id") % 4 == 2, ".jpg").otherwise(".xlsx")
    outcome = F.when(F.col("id") % 3 == 0, "parsed").when(F.col("id") % 3 == 1, "failed:no_grid").otherwise("skipped:unsupported_layout")
    return L.ledger_health(v("document").select(F.col("id").alias("document_id"), F.concat("name", ext).alias("name"), (F.coalesce("body", F.lit("")) != "").alias("has_text"), outcome.alias("outcome"))).select("document_id", "action")


@query("ledger", sql=""", l as (select bid_id, project_id, amount_type, amount, case when bid_id % 3 <> 0 then concat('S', bid_id) end as code from ledger where side = 'cost' and amount_type in ('material', 'labour')), i as (select distinct project_id, bid_id from ledger where bid_id % 2 = 0)
select l.bid_id, l.project_id, count(*) as n, sum(amount)::double as line_sum, count(case when code is not null and i.bid_id is null then 1 end) as unresolved from l left join i on i.project_id = l.project_id and code = concat('S', i.bid_id) group by 1, 2""")
def bid_ingest(v):
    ledger = v("ledger")
    code = F.concat(F.lit("S"), F.col("bid_id").cast("string"))
    lines = ledger.filter("side = 'cost'").select("bid_id", "project_id", F.when(F.col("amount_type").isin("material", "labour"), "line_item").otherwise("division_total").alias("kind"), "amount_type", "amount", F.when(F.col("bid_id") % 3 != 0, code).alias("item_code"), F.lit(0).cast("decimal(18,2)").alias("stated_total"))
    items = ledger.filter("bid_id % 2 = 0").select("project_id", code.alias("item_code"), F.col("bid_id").alias("id")).distinct()
    _, rows = L.bid_ingest(lines, items)
    return rows.groupBy("bid_id", "project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("line_sum"), F.count(F.when(F.col("unresolved"), 1)).alias("unresolved"))


@query("bid", "ledger", "project", sql=""", b as (select id, package_id as project_id, amount from bid where status = 'selected' and id in (select bid_id from ledger where cost_status = 'quoted') and id % 12 <> 2)
select b.id as bid_id, b.project_id, concat(p.code, '-', lpad((7 + row_number() over (partition by b.project_id order by b.id))::varchar, 3, '0')) as number, amount::double as amount from b join project p on p.id = b.project_id""")
def po_award(v):
    bids = v("bid").withColumnRenamed("package_id", "project_id")
    existing = bids.select("project_id").distinct().select(F.lit(-1).cast("bigint").alias("bid_id"), "project_id", F.lit("x-007").alias("number")).unionByName(bids.filter("id % 12 = 2").select(F.col("id").alias("bid_id"), "project_id", F.lit("x-001").alias("number")))
    return L.po_award(bids, v("ledger"), existing, v("project"))["orders"]
