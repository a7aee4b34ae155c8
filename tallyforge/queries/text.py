"""Scalar functions, text and retrieval over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import TODAY
from ..functions import money as M
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import retrieval as R
from ..rules import STOPWORDS
from .money import _BY_TYPE, _FIN, _MARKED
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in (" + _STOP + ")))"


@query("text", sql=f"select document_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(translate(text, '{X.ACCENTED}', '{X.FOLDED}'), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) as name from text")
def normalize_name(v):
    return v("text").select("document_id", F.md5(X.normalize_name(F.col("text"))).alias("name"))


@query("receipt", sql="select id, trim(regexp_replace(lower(coalesce(job_name, '')), '[^a-z0-9]+', ' ', 'g')) as job from receipt")
def normalize_job(v):
    return v("receipt").select("id", X.normalize_job(F.col("job_name")).alias("job"))


@query("text", sql="""select document_id, md5(array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' and x not in ('rue', 'av', 'ave', 'avenue', 'chemin', 'ch', 'blvd', 'boul', 'boulevard') and not regexp_matches(x, '[0-9]')), lambda x: case when x = 'saint' then 'st' else x end), '')) as street from text""")
def street_signature(v):
    return v("text").select("document_id", F.md5(X.street_signature(F.col("text"))).alias("street"))


@query("receipt", sql="select id, case id % 4 when 0 then total when 1 then -abs(total) when 2 then total when 3 then round(total, 0) end::double as amount from receipt")
def parse_money(v):
    t = F.col("total")
    cell = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("$ "), F.format_number(t, 2))).when(F.col("id") % 4 == 1, F.concat(F.lit("("), F.format_number(F.abs(t), 2), F.lit(")")))
        .when(F.col("id") % 4 == 2, F.replace(F.concat(F.when(t < 0, "-").otherwise(""), F.abs(t).cast("string")), F.lit("."), F.lit(","))).otherwise(F.format_number(F.round(t, 0), 0))
    )
    return v("receipt").select("id", M.parse_money(cell).alias("amount"))


@query("receipt", sql="select id, sales_date as day from receipt")
def parse_date_multi(v):
    text = F.when(F.col("id") % 3 == 0, F.date_format("sales_date", "dd/MM/yyyy")).when(F.col("id") % 3 == 1, F.date_format("sales_date", "yyyy-MM-dd")).otherwise(F.date_format("sales_date", "dd-MM-yyyy"))
    return v("receipt").select("id", M.parse_date_multi(text).alias("day"))


@query("message", sql="select id, case when id % 11 = 0 then null else lpad((id % 24)::varchar, 2, '0') || ':' || lpad((id % 60)::varchar, 2, '0') end as clock from message")
def parse_clock(v):
    h, m = F.col("id") % 24, F.lpad((F.col("id") % 60).cast("string"), 2, "0")
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string")
    cell = (
        F.when(F.col("id") % 11 == 0, "noon").when(F.col("id") % 3 == 0, F.concat(h.cast("string"), F.lit(":"), m)).when(F.col("id") % 3 == 1, F.concat(twelve, F.lit(":"), m, F.when(h < 12, " AM").otherwise(" pm"))).otherwise(F.concat(h.cast("string"), F.lit("h"), m))
    )
    return v("message").select("id", M.parse_clock(cell).alias("clock"))


@query("claim", sql="select id, case when time_arrived is not null and time_left is not null and 9 - (id % 20) * 0.5 >= 0 then round(9 - (id % 20) * 0.5, 2)::double end as hours from claim")
def worked_hours(v):
    return v("claim").select("id", M.worked_hours(F.col("time_arrived"), F.col("time_left"), (F.col("id") % 20 * 0.5).cast("decimal(6,2)")).alias("hours"))


@query("claim", sql="""select id, array_to_string(list_filter([case when work_date is null then 'date' end, case when time_arrived is null then 'time_arrived' end, case when time_left is null then 'time_left' end, case when total_hours_reported is null then 'total_hours' end], lambda x: x is not null), ',') as missing,
 time_arrived is null and time_left is null and total_hours_reported is null as blank, coalesce(abs(total_hours_reported - case when time_arrived is not null and time_left is not null then 9 end) > 0.25, false) as mismatch from claim""")
def validate_time_rows(v):
    from ..operators import labour as L

    return L.validate_time_rows(v("claim").withColumn("lunch_hours", F.lit(0).cast("decimal(6,2)"))).select("id", F.array_join("missing", ",").alias("missing"), "blank", "mismatch")


@query("ledger", sql="select distinct bid_id, case bid_id % 5 when 0 then '10-12' when 1 then '10-12' when 2 then '09' when 3 then '22' else 'X7' end as division from ledger")
def canonical_division(v):
    code = F.when(F.col("bid_id") % 5 == 0, "1012").when(F.col("bid_id") % 5 == 1, " 11").when(F.col("bid_id") % 5 == 2, "9").when(F.col("bid_id") % 5 == 3, "22").otherwise("X7")
    return v("ledger").select("bid_id", M.canonical_division(code).alias("division")).distinct()


@query(sql="select p_partkey, case p_partkey % 6 when 0 then '22' when 1 then '09' when 2 then '02' when 3 then '26' when 4 then '10-12' else '99' end as division from part")
def classify_division(v):
    k = F.col("p_partkey") % 6
    hint = F.when(k == 0, "Div. 22").when(k == 1, "Painting - paints")
    text = F.when(k == 2, "Demolition of wall").when(k == 3, "Électricité et éclairage").when(k == 4, "Cabinets").otherwise(F.lit("zzz"))
    return v("part").select("p_partkey", M.classify_division(hint, text).alias("division"))


@query("document", sql="select id, case when contains(lower(name), 'cost') then 'unknown' when contains(lower(name), 'quote') then 'quote' else 'unknown' end as sheet_type from document where name not like 'Invoice%' union all select id, 'extras' from document where name like 'Invoice%'")
def classify_sheet(v):
    return v("document").select("id", M.classify_sheet(F.col("name"), F.when(F.col("name").startswith("Invoice"), "CO #,Item\n1,x").otherwise(F.lit("a,b"))).alias("sheet_type"))


@query("document", sql="select id, case id % 7 when 0 then 'accepted' when 1 then null when 2 then 'proposed' when 3 then 'accepted' when 4 then null when 5 then 'unknown' else 'unknown' end as status from document")
def classify_extras_status(v):
    k = F.col("id") % 7
    cell = F.when(k == 0, "Accepted").when(k == 1, "Not Accepted").when(k == 2, "En cours").when(k == 3, "Acceptée").when(k == 4, "refusé").when(k == 5, " ").otherwise(F.lit("???"))
    return v("document").select("id", M.classify_extras_status(cell).alias("status"))


@query("financial_record", "document", sql=_BY_TYPE + "select project_id, document_id, money_type, count(*) as n from typed group by all")
def classify_money_type(v):
    named = v("financial_record").join(v("document").select(F.col("id").alias("document_id"), "name", "folder_path"), "document_id", "left")
    return named.groupBy("project_id", "document_id", A.money_type(F.col("direction"), F.col("record_kind"), F.col("name"), F.col("folder_path")).alias("money_type")).agg(F.count(F.lit(1)).alias("n"))


@query("document", sql="select id, name like 'Cost tracker%' or id % 5 = 0 as is_rollup from document")
def is_rollup(v):
    return v("document").select("id", M.is_rollup(F.col("name"), F.when(F.col("id") % 5 == 0, "x Market Value y").otherwise(F.col("body"))).alias("is_rollup"))


@query("ledger", sql="select document_id, amount_type, bool_or(amount_type = 'tax' or bid_id % 9 = 0) as any_tax from ledger group by 1, 2")
def is_tax_line(v):
    text = F.when(F.col("bid_id") % 9 == 0, "TPS on materials").otherwise(F.lit("taxi fare"))
    return v("ledger").groupBy("document_id", "amount_type").agg(F.max(M.is_tax_line(F.col("amount_type"), text)).alias("any_tax"))


@query("document", sql="select id, case id % 4 when 0 then (900 + id % 90)::varchar when 1 then null when 2 then 'exterior' end as unit, case when id % 3 = 0 then 'accepted' when id % 3 = 1 then 'proposed' else 'unknown' end as status, case when id % 2 = 0 then 'USD' else 'CAD' end as currency from document")
def doc_name_facts(v):
    n = (900 + F.col("id") % 90).cast("string")
    mark = F.when(F.col("id") % 3 == 0, " ACCEPTED QUOTE").when(F.col("id") % 3 == 1, " quote (not started)").otherwise(" draft")
    name = F.concat(F.when(F.col("id") % 4 == 0, F.concat(F.lit("_"), n)).when(F.col("id") % 4 == 1, F.concat(n, F.lit("-"), n)).when(F.col("id") % 4 == 2, "Exterior").otherwise("misc"), mark)
    text = F.when(F.col("id") % 2 == 0, "Total (USD)").otherwise(F.lit("Total"))
    return v("document").select("id", M.doc_unit(name).alias("unit"), M.doc_status(name).alias("status"), M.doc_currency(text).alias("currency"))


@query("bid", sql="select id, case when id % 5 = 0 then 'pending' else status end as status from bid")
def bid_status_from_name(v):
    name = F.when(F.col("id") % 5 == 0, "plain.xlsx").otherwise(F.concat(F.lit("2026001_QUOTE_"), F.initcap("status"), F.lit(".xlsx")))
    return v("bid").select("id", M.bid_status_from_name(name).alias("status"))


@query("task", sql="select project_id, id, case when status = 'CANCELLED' then 'TODO' else status end as status from task")
def map_status_labels(v):
    label = F.when(F.col("status") == "IN_PROGRESS", "Working on it").when(F.col("status") == "BLOCKED", " Stuck").when(F.col("status") == "DONE", "Done").when(F.col("status") == "TODO", "On Hold").otherwise("mystery")
    return v("task").select("project_id", "id", M.map_status_labels(label).alias("status"))


@query("document", sql="select id, list_max(list_transform(regexp_extract_all(coalesce(body, ''), '\\$\\s?([0-9][0-9,]*(?:\\.[0-9]{1,2})?)', 1), lambda x: replace(x, ',', '')::decimal(18,2)))::double as largest from document")
def money_in_text(v):
    return v("document").select("id", F.array_max(X.dollar_amounts(F.col("body"))).alias("largest"))


@query("project", "document", sql="""select p.id as project_id, budget::double as budget, m::double as contract, round(abs(m - budget)::double / budget::double, 4) as divergence, coalesce(abs(m - budget)::double / budget::double > 0.15, false) as flagged from project p
join (select project_id, max(list_max(list_transform(regexp_extract_all(coalesce(body, ''), '\\$\\s?([0-9][0-9,]*(?:\\.[0-9]{1,2})?)', 1), lambda x: replace(x, ',', '')::decimal(18,2)))) as m from document where not is_trashed and name like 'Contract%' group by 1) c on c.project_id = p.id where budget > 0 and m is not null""")
def budget_vs_contract(v):
    largest = v("document").filter(~F.col("is_trashed") & F.col("name").startswith("Contract")).groupBy("project_id").agg(F.max(F.array_max(X.dollar_amounts(F.col("body")))).alias("contract")).filter("contract is not null")
    joined = v("project").filter("budget > 0").select(F.col("id").alias("project_id"), "budget").join(largest, "project_id")
    off = F.abs(F.col("contract") - F.col("budget")).cast("double") / F.col("budget").cast("double")
    return joined.select("project_id", "budget", "contract", F.round(off, 4).alias("divergence"), (off > 0.15).alias("flagged"))


_SHORT = """concat(case when {0} < 0 then '-' else '' end, '$', case when abs({0}) >= 1000000 then regexp_replace(format('{{:.1f}}', round((abs({0})::decimal(24,2) / 1000000)::decimal(24,8), 1)::double), '\\.0$', '') || 'M'
 when abs({0}) >= 1000 then regexp_replace(format('{{:.1f}}', round((abs({0})::decimal(24,2) / 1000)::decimal(24,8), 1)::double), '\\.0$', '') || 'k' else round(abs({0}), 0)::bigint::varchar end)"""


@query("receipt", sql=f"select id, {_SHORT.format('total')} as short from receipt")
def money_short(v):
    return v("receipt").select("id", M.money_short(F.col("total")).alias("short"))


@query("financial_record", "document", "obligation", "project", sql=_BY_TYPE + _FIN + _MARKED + f""", o as (select project_id, count(*) as n, coalesce(sum(case when direction = 'owed_to_us' then amount end), 0) as due from marked where status = 'overdue' group by 1),
l as (select project_id, bool_or(classified_ratio < 0.5) as low from by_type group by 1)
select p.id as project_id, concat(p.name, case when f.project_id is null then ': no financial records yet' when l.low then ': money picture of low confidence' when confirmed_client_in > 0 then concat(': revenue ', {_SHORT.format('confirmed_client_in')}, ' | costs ', {_SHORT.format('confirmed_contractor_out')}, ' | margin ~', {_SHORT.format('(confirmed_client_in - confirmed_contractor_out)')})
 else concat(': ', {_SHORT.format('contractor_out_total')}, ' in costs so far') end, case when f.project_id is not null and o.n > 0 then concat(' | ', o.n, ' obligation(s) overdue', case when o.due > 0 then concat(' (', {_SHORT.format('o.due')}, ' to collect)') else '' end) else '' end) as line
from project p left join fin f on f.project_id = p.id left join l on l.project_id = p.id left join o on o.project_id = p.id""")
def money_line(v):
    fin = A.project_financials(v("financial_record"))
    low = A.money_by_type(v("financial_record"), v("document")).groupBy("project_id").agg(F.max("low_confidence").alias("low"))
    marked = v("obligation").withColumn("status", A.obligation_status(TODAY)).filter("status = 'overdue'")
    late = marked.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("direction") == "owed_to_us", F.col("amount"))), F.lit(0)).alias("due"))
    rows = v("project").select(F.col("id").alias("project_id"), "name").join(fin.withColumn("has", F.lit(True)), "project_id", "left").join(low, "project_id", "left").join(late, "project_id", "left")
    short = lambda c: M.money_short(F.col(c))
    head = (
        F.when(F.col("has").isNull(), ": no financial records yet").when(F.col("low"), ": money picture of low confidence")
        .when(F.col("confirmed_client_in") > 0, F.concat(F.lit(": revenue "), short("confirmed_client_in"), F.lit(" | costs "), short("confirmed_contractor_out"), F.lit(" | margin ~"), short("confirmed_margin"))).otherwise(F.concat(F.lit(": "), short("contractor_out_total"), F.lit(" in costs so far")))
    )
    collect = F.when(F.col("due") > 0, F.concat(F.lit(" ("), short("due"), F.lit(" to collect)"))).otherwise("")
    tail = F.when(F.col("has") & (F.col("n") > 0), F.concat(F.lit(" | "), F.col("n").cast("string"), F.lit(" obligation(s) overdue"), collect)).otherwise("")
    return rows.select("project_id", F.concat("name", head, tail).alias("line"))


@query("text", sql=f", q as (select list_distinct(list_filter(regexp_extract_all('the and station of thand ination 42', '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in ({_STOP}))) as qt) select document_id, round(case when len({_TOK.format('text')}) > 0 then len(list_intersect(qt, {_TOK.format('text')}))::double / len(qt) else 0 end, 6) as score from text, q")
def keyword_score(v):
    return v("text").select("document_id", F.round(X.keyword_score(X.keyword_tokens(F.lit("the and station of thand ination 42")), X.keyword_tokens(F.col("text"))), 6).alias("score"))


@query()
def chunk_documents(v):
    """Greedy packing: tested against brute force."""
    return R.chunk_documents(v("text")).drop("text")


@query()
def incremental_chunks(v):
    chunks = R.chunk_documents(v("text"))
    from pyspark.sql import functions as G

    keyed = chunks.filter("document_id % 3 <> 0").withColumn("key", G.sha2(G.concat_ws("|", "text", G.lit("hash"), G.lit("64")), 256))
    stored = keyed.groupBy("document_id").agg(G.transform(G.array_sort(G.collect_list(G.struct("chunk_index", "key"))), lambda x: x["key"]).alias("hashes"))
    return R.incremental_chunks(chunks, stored).select("document_id", "chunk_index", "content_hash")


@query("text", sql="""
, w as (select document_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from text), b as (select document_id, ('0x' || right(md5(w), 8))::bigint % 64 as b, count(*)::double as n from w group by 1, 2),
m as (select document_id, sqrt(sum(n * n)) as norm, count(*) as buckets, max(n) as top from b group by 1) select document_id, buckets, round(top / norm, 6) as top from m""")
def hash_embed(v):
    e = R.hash_embed(v("text"))
    return e.select("document_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("buckets"), F.round(F.array_max("embedding"), 6).alias("top"))


@query("vector", sql=f"""
, c as (select id, embedding, concat('label ', label, ' item ', id % 7) as text from vector), q as (select id as query_id, embedding as qv, {_TOK.format("concat('label ', label, ' item')")} as qt from vector where id % 20 = 0),
s as (select query_id, id, round(list_dot_product(qv::double[], embedding::double[]) / (sqrt(list_dot_product(qv::double[], qv::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as similarity, round(len(list_intersect(qt, {_TOK.format('text')}))::double / len(qt), 6) as keyword from c, q),
r as (select *, row_number() over (partition by query_id order by similarity desc, id) - 1 as sr, row_number() over (partition by query_id order by keyword desc, id) - 1 as kr from s),
f as (select *, round(1.0::double / (60 + sr) + 1.0::double / (60 + kr), 9) as score from r where similarity >= 0 or keyword > 0)
select query_id, id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from f) where rank <= 12""")
def hybrid_search(v):
    vec = v("vector")
    chunks = vec.select("id", "embedding", F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" item "), (F.col("id") % 7).cast("string")).alias("text"))
    queries = vec.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding", F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" item")).alias("query_text"))
    return R.hybrid_search(queries, chunks).select("query_id", "id", "score", "rank")


@query("document", sql="select id as document_id, case id % 3 when 0 then id % 1000 + 0.5 when 1 then project_id * 1000.0 else 7777777.77 end::double as amount, body is not null and body <> '' and (id % 3 = 0 or (id % 3 = 1)) as found from document")
def amount_grounding(v):
    d = v("document")
    amount = F.when(F.col("id") % 3 == 0, F.col("id") % 1000 + F.lit(0.5)).when(F.col("id") % 3 == 1, F.col("project_id") * F.lit(1000.0)).otherwise(7777777.77).cast("decimal(14,2)")
    return R.amount_grounding(d.select(F.col("id").alias("document_id"), amount.alias("amount")), d.select(F.col("id").alias("document_id"), F.col("body").alias("text")))


@query("document", sql="select project_id as document_id, count(*) as n_rows, count(case when id % 2 = 0 then 1 end) as verified, count(case when id % 3 = 0 and body <> '' then 1 end) as found, project_id % 4 = 0 as missing_text from document group by project_id")
def audit_summary(v):
    d = v("document")
    rows = d.select(F.col("project_id").alias("document_id"), (F.col("id") % 2 == 0).alias("verified"), (F.coalesce(F.col("body"), F.lit("")) != "").alias("_b"), F.col("id")).withColumn("found", F.col("_b") & (F.col("id") % 3 == 0))
    texts = d.select(F.col("project_id").alias("document_id"), F.when(F.col("project_id") % 4 != 0, "t").alias("text")).distinct()
    return R.audit_summary(rows, texts)


@query(sql="select n_regionkey, concat('| key | name |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', n_nationkey, ' | ', n_name, ' |'), chr(10) order by n_nationkey)) as markdown from nation group by 1")
def render_markdown_table(v):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit("\t"), x["n_name"]))
    return v("nation").groupBy("n_regionkey").agg(F.concat(F.lit("key\tname\n"), F.array_join(lines, "\n")).alias("t")).select("n_regionkey", R.render_markdown_table(F.col("t")).alias("markdown"))
