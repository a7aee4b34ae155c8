"""Joins and identity resolution over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..rules import CONTRACT_NAME
from .registry import query


def _first(tiers: list[tuple[str, str, float, bool]]) -> str:
    """Oracle of precedence_join: tiers of (CTE with key, target; method; confidence; unique)."""
    union = " union all ".join(
        f"select key, {i} as rank, min(target) as target, '{m}' as method, {c}::double as confidence from {t} group by key{' having count(distinct target) = 1' if u else ''}" for i, (t, m, c, u) in enumerate(tiers)
    )
    return f"select k.key, h.target, coalesce(h.method, 'unresolved') as method, coalesce(h.confidence, 0.0::double) as confidence from (select distinct key from keys) k left join (select * from ({union}) qualify row_number() over (partition by key order by rank) = 1) h on h.key is not distinct from k.key"


_NJ = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_PHRASE = "{0} <> '' and {1} <> '' and contains(concat(' ', {1}, ' '), concat(' ', {0}, ' '))"


@query("document", "text", sql="select d.id, d.project_id, t.lang from document d join text t on t.document_id = d.id where not is_trashed and text is not null")
def docs_with_text(v):
    return J.docs_with_text(v("document"), v("text")).select("id", "project_id", "lang")


@query("document", "text", sql="select id, project_id from document where id not in (select document_id from text)")
def docs_missing_text(v):
    return J.docs_missing_text(v("document"), v("text")).select("id", "project_id")


@query("project", "document", sql="select id, name, status from project p where status in ('ACTIVE', 'PROPOSED') and id % 10 <> 9 and not exists (select 1 from document d where d.project_id = p.id and not is_trashed and regexp_matches(d.name, '(?i)contract|agreement|contrat|entente'))")
def missing_documents(v):
    return J.missing_documents(v("project"), v("document"), v("project").filter("id % 10 = 9"), pattern=CONTRACT_NAME).select("id", "name", "status")


@query("receipt", "project", sql=f""", keys as (select distinct job_name as key from receipt where job_name is not null), n as (select key, {_NJ.format('key')} as job from keys), d as (select id as target, {_NJ.format('name')} as pname, {_NJ.format('code')} as pcode, id from project),
t0 as (select key, target from n join d on job <> '' and (job = pname or job = pcode)), t1 as (select key, target from n join d on ({_PHRASE.format('job', 'pname')}) or ({_PHRASE.format('pname', 'job')})), t2 as (select key, target from n join d on ({_PHRASE.format('job', 'pcode')}) or ({_PHRASE.format('pcode', 'job')})),
tok as (select key, list_transform(list_filter(string_split(job, ' '), lambda x: x <> '' and x not in ('rue', 'av', 'ave', 'avenue', 'chemin', 'ch', 'blvd', 'boul', 'boulevard') and not regexp_matches(x, '[0-9]')), lambda x: case when x = 'saint' then 'st' else x end) as ts from n),
cand as (select key, unnest(list_distinct(list_filter([ts[1], ts[1] || ts[2]], lambda x: x is not null and length(x) >= 3))) as c from tok),
st as (select target, array_to_string(list_transform(list_filter(string_split(pname, ' '), lambda x: x <> '' and not regexp_matches(x, '[0-9]') and x not in ('rue', 'av', 'ave', 'avenue', 'chemin', 'ch', 'blvd', 'boul', 'boulevard')), lambda x: case when x = 'saint' then 'st' else x end), '') as s from d),
t3 as (select distinct key, target from cand join st on length(s) >= 3 and (starts_with(s, c) or starts_with(c, s)))
""" + _first([("t0", "job_name", 1.0, False), ("t1", "job_phrase", 0.8, False), ("t2", "job_code", 0.85, False), ("t3", "street_prefix", 0.7, True)]))
def job_to_project(v):
    return J.job_to_project(v("receipt").filter("job_name is not null").select(F.col("job_name").alias("key")), v("project"))


@query("receipt", "project", sql=""", r as (select *, coalesce(project_id, 0) as p from receipt), keys as (select distinct case id % 6 when 0 then p::varchar when 1 then concat('J', p) when 2 then coalesce(job_name, 'none') when 3 then concat(' OLD-', p) when 4 then concat('the ', p) else substr(concat('CUSTOMER#', lpad(p::varchar, 9, '0')), 3) end as key from r),
k as (select key, lower(trim(key)) as ref from keys where trim(key) <> ''), t0 as (select key, id as target from k join project on ref = id::varchar), t1 as (select key, id as target from k join project on ref = lower(code)),
t2 as (select key, id as target from k join project on id % 2 = 0 and ref = concat('old-', id)), t3 as (select key, id as target from k join project on id % 3 <> 0 and ref = concat('the ', id)), t4 as (select key, id as target from k join project on contains(lower(name), ref))
""" + _first([("t0", "id", 1.0, False), ("t1", "code", 1.0, False), ("t2", "legacy_number", 0.95, False), ("t3", "alias", 0.9, False), ("t4", "name", 0.8, False)]))
def resolve_project_ref(v):
    own = F.coalesce("project_id", F.lit(0)).cast("string")
    part = F.substring(F.concat(F.lit("CUSTOMER#"), F.lpad(own, 9, "0")), 3, 99)
    kind = F.col("id") % 6
    key = F.when(kind == 0, own).when(kind == 1, F.concat(F.lit("J"), own)).when(kind == 2, F.coalesce("job_name", F.lit("none"))).when(kind == 3, F.concat(F.lit(" OLD-"), own)).when(kind == 4, F.concat(F.lit("the "), own)).otherwise(part)
    number = F.col("id").cast("string")
    projects = v("project").withColumns({"legacy_number": F.when(F.col("id") % 2 == 0, F.concat(F.lit("old-"), number)), "aliases": F.when(F.col("id") % 3 != 0, F.array(F.lit("x"), F.concat(F.lit("The "), number)))})
    return J.resolve_project_ref(v("receipt").select(key.alias("key")), projects)


@query("document", "project", sql=""", p as (select id as target, concat(100 + id % 400, ' Rue Saint ', name) as name from project), keys as (select distinct case id % 3 when 0 then concat(100 + project_id % 400, '-', 100 + project_id % 400 + 1, ' Depot') when 1 then concat(100 + project_id % 400, ' rue SAINT ', 'Customer#', lpad(project_id::varchar, 9, '0')) else name end as key from document),
c as (select key, unnest(list_distinct(list_filter([regexp_extract(key, '^\\s*(\\d{3,5})(?:[-\\s]+(\\d{3,5}))?\\b', 1), regexp_extract(key, '^\\s*(\\d{3,5})(?:[-\\s]+(\\d{3,5}))?\\b', 2)], lambda x: x <> ''))) as civic from keys), pc as (select target, regexp_extract(name, '^(\\d{3,5})', 1) as civic from p),
t0 as (select distinct key, target from c join pc using (civic)), t1 as (select key, target from keys join p on trim(regexp_replace(regexp_replace(lower(key), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) = trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))
""" + _first([("t0", "civic", 1.0, True), ("t1", "name", 1.0, True)]))
def civic_match(v):
    civic = lambda c: (100 + F.col(c) % 400).cast("string")
    project = v("project").withColumn("name", F.concat(civic("id"), F.lit(" Rue Saint "), F.col("name")))
    key = (
        F.when(F.col("id") % 3 == 0, F.concat(civic("project_id"), F.lit("-"), (101 + F.col("project_id") % 400).cast("string"), F.lit(" Depot")))
        .when(F.col("id") % 3 == 1, F.concat(civic("project_id"), F.lit(" rue SAINT Customer#"), F.lpad(F.col("project_id").cast("string"), 9, "0"))).otherwise(F.col("name"))
    )
    return J.civic_match(v("document").select(key.alias("key")), project)


@query("project", sql=", l as (select id as key, upper(name) as name, status from project) select key, min(p.id) as target from l join project p on lower(trim(l.name)) = lower(trim(p.name)) and lower(l.status) = lower(p.status) group by 1 having count(*) = 1")
def exact_match(v):
    left = v("project").select(F.col("id").alias("key"), F.upper("name").alias("name"), "status")
    return J.exact_match(left, v("project"), ["name", "status"])


@query(sql="""with l as (select distinct concat(p_name, ' x') as n, min(p_partkey) as key from part group by 1), r as (select p_name as n, min(p_partkey) as id from part group by 1),
s as (select key, id, 1 - levenshtein(l.n, r.n)::double / greatest(length(l.n), length(r.n)) as score from l, r)
select key, id as target, score from (select *, row_number() over (partition by key order by score desc, id) as k from s where score >= 0.8) where k = 1""")
def fuzzy_match(v):
    part = v("part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return J.fuzzy_match(part.select(F.col("id").alias("key"), F.concat("name", F.lit(" x")).alias("name")), part, ["name"], threshold=0.8)


@query("receipt", "project", sql=f""", keys as (select distinct coalesce(job_name, '?') as key from receipt), a as (select key, id as target from keys join project on lower(key) = lower(name)), b as (select key, id as target from keys join project on starts_with(lower(key), concat(lower(code), ' ')))
""" + _first([("a", "name", 1.0, False), ("b", "code", 0.9, True)]))
def precedence_join(v):
    keys = v("receipt").select(F.coalesce("job_name", F.lit("?")).alias("key")).distinct()
    project = v("project")
    by_name = keys.join(project, F.lower("key") == F.lower("name")).select("key", F.col("id").alias("target"))
    by_code = keys.join(project, F.get(F.split(F.lower("key"), " "), 0) == F.lower("code")).filter(F.contains("key", F.lit(" "))).select("key", F.col("id").alias("target"))
    return J.precedence_join(keys, [J.Strategy(by_name, "name", 1.0), J.Strategy(by_code, "code", 0.9, True)])


@query("proposal", "task", sql=", t as (select project_id * 10 + id as tid, project_id from task) select p.id, entity_type, entity_id, case when entity_type = 'project' then entity_id else t.project_id end as project_id from proposal p left join t on t.tid = p.entity_id")
def polymorphic_join(v):
    return J.polymorphic_join(v("proposal"), v("task").select((F.col("project_id") * 10 + F.col("id")).alias("id"), "project_id"))


@query()
def duplicate_twins(v):
    """Greedy one-to-one: tested against a plain loop instead of SQL."""
    return J.duplicate_twins(v("receipt").withColumn("total", F.round(F.col("total") / 5000, 0).cast("decimal(14,2)")), day_window=200)


@query("document", sql="""select a.project_id, a.id as a, b.id as b, abs(a.stated_total - b.stated_total)::double as gap, case when a.id % 6 = 0 or b.id % 6 = 0 then 'high' else 'medium' end as severity
from document a join document b on a.project_id = b.project_id and a.id < b.id and abs(a.stated_total - b.stated_total) <= greatest(1.0, abs(a.stated_total) * 0.005)""")
def duplicate_totals(v):
    return J.duplicate_totals(v("document").select("project_id", F.col("id").alias("document_id"), F.col("stated_total").alias("total"), (F.col("id") % 6 == 0).alias("is_rollup")))


_MSG = """, m as (select id, sender, case id % 4 when 0 then concat('at Customer#', lpad(project_hint::varchar, 9, '0'), 's today') when 1 then concat('(Harbour', project_hint % 5, ') visit') when 2 then 'at harbourside' else 'rain again' end as text from message),
p as (select id, case when id % 3 = 0 then concat('12-14 Harbour', id % 5, ' / ', name) else name end as name from project), keys as (select id as key from m), w as (select distinct lower(text) as words from m), d as (select id as target, lower(trim(name)) as pname from p),
n as (select words, min(target) as target from w join d on contains(words, pname) group by 1), tok as (select min(target) as target, w from (select target, regexp_replace(unnest(string_split_regex(pname, '[\\s\\-/]+')), '^[.,:()]+|[.,:()]+$', '', 'g') as w from d) where length(w) >= 4 group by w),
x as (select words, min(target) as target from w join tok on regexp_matches(words, concat('\\b', regexp_escape(w), '\\b')) group by 1),
"""


@query("message", "project", sql=_MSG + """t0 as (select id as key, target from m join n on lower(text) = words), t1 as (select id as key, target from m join x on lower(text) = words), t2 as (select id as key, sender % 20 as target from m where sender % 3 = 0), t3 as (select id as key, sender % 7 as target from m where sender % 3 = 1)
""" + _first([("t0", "text_match", 0.9, False), ("t1", "text_match_word", 0.75, False), ("t2", "worker_default", 0.6, False), ("t3", "sender_recency", 0.5, False)]))
def sender_attribution(v):
    hint = F.col("project_hint")
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("at Customer#"), F.lpad(hint.cast("string"), 9, "0"), F.lit("s today"))).when(F.col("id") % 4 == 1, F.concat(F.lit("(Harbour"), (hint % 5).cast("string"), F.lit(") visit"))).when(F.col("id") % 4 == 2, "at harbourside").otherwise("rain again")
    message = v("message").withColumn("text", text)
    named = v("project").withColumn("name", F.when(F.col("id") % 3 == 0, F.concat(F.lit("12-14 Harbour"), (F.col("id") % 5).cast("string"), F.lit(" / "), F.col("name"))).otherwise(F.col("name")))
    sender = message.select("sender").distinct()
    return J.sender_attribution(message, named, sender.filter("sender % 3 = 0").withColumn("project_id", F.col("sender") % 20), sender.filter("sender % 3 = 1").withColumn("project_id", F.col("sender") % 7))


@query("task", sql=", t as (select *, case when id > 1 then id // 2 end as parent_id from task) select t.project_id, t.id, t.title, p.title as parent_title, p.status as parent_status, p.start_date as parent_start from t left join task p on p.project_id = t.project_id and p.id = t.parent_id")
def task_parent_join(v):
    tasks = v("task").withColumn("parent_id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2).cast("int")))
    return J.task_parent_join(tasks).select("project_id", "id", "title", "parent_title", "parent_status", "parent_start")


@query("task", sql=""", l as (select project_id, id as successor_id, [id - 1, id + 40] as linked_ids, concat('Task ', id + 1, ' of ', project_id) as title from task), i as (select project_id, successor_id, unnest(linked_ids) as predecessor_id from l), byid as (select i.* from i join task t on t.project_id = i.project_id and t.id = i.predecessor_id),
bt as (select l.project_id, l.successor_id, t.id as predecessor_id from l join task t on t.project_id = l.project_id and t.title = l.title where not exists (select 1 from byid b where b.project_id = l.project_id and b.successor_id = l.successor_id))
select distinct project_id, predecessor_id, successor_id from (select project_id, predecessor_id, successor_id from byid union all select project_id, predecessor_id, successor_id from bt) where predecessor_id <> successor_id""")
def dependency_edges(v):
    task = v("task")
    links = task.select("project_id", F.col("id").alias("successor_id"), F.array(F.col("id") - 1, F.col("id") + 40).alias("linked_ids"), F.array(F.concat(F.lit("Task "), (F.col("id") + 1).cast("string"), F.lit(" of "), F.col("project_id").cast("string"))).alias("linked_titles"))
    return J.dependency_edges(links, task)


@query("document", "project", "receipt", "receipt_line", sql="""
select 'document.project' as relation, count(*) as n from document where project_id not in (select id from project where id % 5 <> 0) union all select 'line.receipt', count(*) from receipt_line where receipt_id not in (select id from receipt)
union all select 'receipt.project', count(*) from receipt where project_id is not null and project_id not in (select id from project)""")
def fk_orphans(v):
    return J.fk_orphans({"document.project": (v("document"), "project_id", v("project").filter("id % 5 <> 0"), "id"), "line.receipt": (v("receipt_line"), "receipt_id", v("receipt"), "id"), "receipt.project": (v("receipt"), "project_id", v("project"), "id")})


@query("document", "project", sql="select d.id, d.project_id from document d join project p on p.id = d.project_id where not list_contains(string_split(folder_path, '/'), p.name)")
def mislinked_documents(v):
    return J.mislinked_documents(v("document"), v("project")).select("id", "project_id")


@query("message", sql=""", keys as (select distinct case when sender % 4 = 3 then concat('NEW  hand ', sender) when sender % 4 = 2 then concat('al. ', sender) else concat('Worker  ', sender) end as key from message), n as (select key, trim(regexp_replace(regexp_replace(lower(key), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as n from keys),
s as (select distinct sender as id from message), t0 as (select key, id::varchar as target from n join s on n = concat('worker ', id)), t1 as (select key, id::varchar as target from n join s on n = concat('al ', id)),
r as (""" + _first([("t0", "exact", 1.0, True), ("t1", "alias", 0.9, True)]) + """) select r.key, case when method = 'unresolved' then concat('stub:', sha256(n.n)) else target end as target, case when method = 'unresolved' then 'stub' else method end as method, case when method = 'unresolved' then 0.6::double else confidence end as confidence from r join n on n.key = r.key""")
def worker_resolution(v):
    sender = v("message").select("sender").distinct()
    key = F.when(F.col("sender") % 4 == 3, F.concat(F.lit("NEW  hand "), F.col("sender").cast("string"))).when(F.col("sender") % 4 == 2, F.concat(F.lit("al. "), F.col("sender").cast("string"))).otherwise(F.concat(F.lit("Worker  "), F.col("sender").cast("string")))
    workers = sender.select(F.col("sender").alias("id"), F.concat(F.lit("Worker "), F.col("sender").cast("string")).alias("name"))
    aliases = sender.select(F.col("sender").alias("worker_id"), F.concat(F.lit("Al "), F.col("sender").cast("string")).alias("alias"))
    return J.worker_resolution(v("message").select(key.alias("key")), workers, aliases)


@query("message", "project", sql=""", keys as (select distinct case sender % 3 when 0 then concat('tomer#', lpad(sender::varchar, 9, '0')) when 1 then concat('yard ', sender) else concat('near Customer#', lpad(sender::varchar, 9, '0'), 's rear') end as key from message), n as (select key, lower(trim(key)) as s from keys), d as (select id as target, lower(name) as pname from project),
t0 as (select key, target from n join d on contains(pname, s) or contains(s, pname)), t1 as (select key, length(key) as target from keys where key like 'yard %')
""" + _first([("t0", "site_name", 0.9, False), ("t1", "hint", 0.5, False)]))
def site_resolution(v):
    padded = F.lpad(F.col("sender").cast("string"), 9, "0")
    key = F.when(F.col("sender") % 3 == 0, F.concat(F.lit("tomer#"), padded)).when(F.col("sender") % 3 == 1, F.concat(F.lit("yard "), F.col("sender").cast("string"))).otherwise(F.concat(F.lit("near Customer#"), padded, F.lit("s rear")))
    sites = v("message").select(key.alias("key"))
    hints = sites.filter("key like 'yard %'").distinct().withColumn("project_id", F.length("key").cast("long"))
    return J.site_resolution(sites, v("project"), hints)


@query("message", "project", sql=""", m as (select id, case when id % 50 = 0 then 'noreply@x.org' else concat('u', sender, '@x.org') end as sender, case id % 3 when 0 then concat('log+j', project_hint, '@y.org') when 1 then 'log@y.org' else concat('log+', case when id % 2 = 0 then 'zzz' else concat('MER#', lpad(project_hint::varchar, 9, '0')) end, '@y.org') end as recipient from message), d as (select distinct concat('u', sender, '@x.org') as sender, sender % 20 as project_id from message where sender % 2 = 0)
select m.id, case when not regexp_matches(m.sender, '(?i)^(no-?reply|mailer-daemon|postmaster)@') then coalesce(p.id, d.project_id, 7) end as project_id,
 case when regexp_matches(m.sender, '(?i)^(no-?reply|mailer-daemon|postmaster)@') then 'quarantined' when p.id is not null then 'plus_tag' when d.project_id is not null then 'sender_default' else 'global_default' end as method, d.project_id is null and not regexp_matches(m.sender, '(?i)^(no-?reply|mailer-daemon|postmaster)@') as new_sender
from (select *, lower(regexp_extract(recipient, '\\+([^@]+)@', 1)) as tag from m) m left join (select tag, coalesce((select min(id) from project where lower(code) = tag), (select min(id) from project where contains(lower(name), tag))) as id from (select distinct lower(regexp_extract(recipient, '\\+([^@]+)@', 1)) as tag from m) where tag <> '') p on p.tag = m.tag left join d on d.sender = m.sender""")
def mail_routing(v):
    name = F.concat(F.lit("u"), F.col("sender").cast("string"), F.lit("@x.org"))
    mails = v("message").select("id", F.when(F.col("id") % 50 == 0, "noreply@x.org").otherwise(name).alias("sender"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("log+j"), F.col("project_hint").cast("string"), F.lit("@y.org"))).when(F.col("id") % 3 == 1, "log@y.org").otherwise(F.concat(F.lit("log+"), F.when(F.col("id") % 2 == 0, "zzz").otherwise(F.concat(F.lit("MER#"), F.lpad(F.col("project_hint").cast("string"), 9, "0"))), F.lit("@y.org"))).alias("recipient"))
    defaults = v("message").filter("sender % 2 = 0").select(name.alias("sender"), (F.col("sender") % 20).alias("project_id")).distinct()
    return J.mail_routing(mails, v("project"), defaults, fallback=7)


@query("document", "project", sql=""", j as (select d.id, d.project_id, case when list_position(string_split(folder_path, '/'), p.name) > 0 then string_split(folder_path, '/')[list_position(string_split(folder_path, '/'), p.name) + 1] end as segment from document d join project p on p.id = d.project_id)
select j.id, j.project_id, j.segment, c.id as context_id, case when j.segment is null then null when c.id is not null then 'RESOLVED' else 'UNRESOLVED' end as state from j left join (select id, id as pid from project where id % 2 = 0) c on c.pid = j.project_id and j.segment = 'Contracts'""")
def scope_context_bind(v):
    contexts = v("project").filter("id % 2 = 0").select("id", F.col("id").alias("project_id"), F.lit("Contracts").alias("name"))
    return J.scope_context_bind(v("document"), v("project"), contexts)


@query("ledger", sql=", i as (select distinct project_id, concat('SOW-', bid_id) as item_code, project_id * 1000 + bid_id as id from ledger where bid_id % 3 <> 0), l as (select distinct project_id, document_id, case when bid_id % 7 <> 0 then concat('SOW-', bid_id) end as item_code from ledger) select l.project_id, l.document_id, l.item_code, i.id as item_id, l.item_code is not null and i.id is null as unresolved from l left join i on i.project_id = l.project_id and i.item_code = l.item_code")
def quote_scope_coverage(v):
    code = F.concat(F.lit("SOW-"), F.col("bid_id").cast("string"))
    items = v("ledger").filter("bid_id % 3 <> 0").select("project_id", code.alias("item_code"), (F.col("project_id") * 1000 + F.col("bid_id")).alias("id")).distinct()
    lines = v("ledger").select("project_id", "document_id", F.when(F.col("bid_id") % 7 != 0, code).alias("item_code")).distinct()
    return J.quote_scope_coverage(lines, items).select("project_id", "document_id", "item_code", "item_id", "unresolved")


@query("receipt", "project", "supplier", sql="""select r.id, (1000000 + r.project_id)::varchar as code, case when r.id % 2 = 0 then '001' end as sequence, 'QUOTE' as doc_type, '09' as division, 'Finishes' as trade, concat('supplier', lpad((r.id % 20)::varchar, 9, '0')) as vendor_slug, 'pending' as status, r.project_id, s.s_suppkey as vendor_id, case when s.s_suppkey is null then 'unresolved' else 'exact' end as vendor_method,
 case when r.project_id % 3 = 0 and p.id is not null then p.id * 10 end as package_id, case when p.id is null then 'unresolved' when p.id % 3 = 0 then 'filename_division_code' when p.id % 3 = 1 then 'ambiguous' else 'none' end as package_method
from receipt r left join project p on p.id = r.project_id left join supplier s on s.s_suppkey = r.id % 20 where r.project_id is not null""")
def filename_resolver(v):
    receipts = v("receipt").filter("project_id is not null")
    code = (1000000 + F.col("project_id")).cast("string")
    name = F.concat(code, F.when(F.col("id") % 2 == 0, "-001").otherwise(""), F.lit("_Quote_09-Finishes_supplier"), F.lpad((F.col("id") % 20).cast("string"), 9, "0"), F.lit("_pending.xlsx"))
    projects = v("project").withColumn("code", (1000000 + F.col("id")).cast("string"))
    vendors = v("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    each = F.when(F.col("id") % 3 == 0, F.array(F.lit(0))).when(F.col("id") % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array().cast("array<int>"))
    packages = v("project").select(F.col("id").alias("project_id"), F.explode(each).alias("k")).select((F.col("project_id") * 10 + F.col("k")).alias("id"), "project_id", F.lit("09").alias("division_code"))
    return J.filename_resolver(receipts.select("id", name.alias("name")), projects, vendors, packages).drop("name")
