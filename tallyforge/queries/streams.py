"""Streaming jobs over events that arrive in several files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import Scratch
from ..streaming import jobs as J
from ..streaming.tables import KeyedTable
from .people import _CLUSTERS
from .registry import query


def _arrive(v, df, scratch, name: str, *, files: int = 3, by: str = "id", after=None):
    """The rows as a stream of files, one per micro-batch, oldest first; the rows of ``after`` come as one more."""
    path = scratch.path(name)
    df = df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"})
    ends = df.agg(F.min(by).alias("lo"), F.max(by).alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) // files + 1 if ends["hi"] is not None else 1
    for k in range(files):
        df.filter(F.floor((F.col(by) - (ends["lo"] or 0)) / step) == k).coalesce(1).write.mode("append").parquet(path)
    if after is not None:
        after.select(*[F.col(f.name).cast(f.dataType) for f in df.schema]).coalesce(1).write.mode("append").parquet(path)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


_TRIES = """, b as (select id, sender, channel, (id - min(id) over ()) // ((max(id) over () - min(id) over ()) // 3 + 1) as k from message),
t as (select *, case when id % 97 = 0 then least(3, 4 - k) when id % 89 = 0 then 2 else 1 end as attempts from b)
"""


@query("message", sql=_TRIES + "select id, sender, channel, attempts::int as attempts, case when id % 97 <> 0 then 'ok' when attempts = 3 then 'dead' else 'failed' end as status from t")
def stream_message_dedup(v):
    """Every message arrives twice in its file and once more in the last one; some fail always, some at first."""
    scratch = Scratch(v.spark)
    message = v("message").select("id", "sender", "channel", "sent_at")
    twice = message.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    stream = _arrive(v, twice, scratch, "in", after=message)
    schema = "id long, sender long, channel string, sent_at timestamp"
    seen = KeyedTable(v.spark, scratch.path("seen"), "id long", ["id"], buckets=8)
    failures = KeyedTable(v.spark, scratch.path("failures"), schema + ", attempts int, error string, status string", ["id"], buckets=8)
    error = F.when(F.col("id") % 97 == 0, "unreadable").when((F.col("id") % 89 == 0) & (F.col("attempts") == 0), "busy")
    J.available(stream, scratch.path("job"), each=J.intake(seen, failures, lambda rows: rows.withColumn("error", error), scratch.path("outcome")))
    last = v.spark.read.parquet(scratch.path("outcome")).groupBy("id").agg(F.max(F.struct("batch", "sender", "channel", "attempts", "status")).alias("m"))
    return last.select("id", "m.sender", "m.channel", "m.attempts", "m.status")


@query("message", sql="select cast(sent_at as date) as day, channel, count(*) as n from message where cast(sent_at as date) < (select cast(max(sent_at) - interval 1 day as date) from message) group by 1, 2")
def stream_daily_changes(v):
    """Days that the watermark has closed; the rest waits for more events."""
    scratch = Scratch(v.spark)
    J.available(J.daily_changes(_arrive(v, v("message").select("id", "sent_at", "channel"), scratch, "in")), scratch.path("job"))
    return v.spark.read.parquet(scratch.path("job/out"))


_FEED = """, e as (select sender as id, case when id % 4 <> 0 then concat('n', id % 10) end as name, case when id % 5 <> 0 then concat('root/', channel) else 'elsewhere' end as folder, case when id % 11 = 0 then 'removed' when id % 13 = 0 then 'folder' else 'changed' end as kind, sent_at as ts, id as seq from message),
k as (select * from e where kind <> 'folder' and (kind = 'removed' or folder like 'root%'))
"""


@query("message", sql=_FEED + "select id, arg_max(name, (ts, seq)) filter (name is not null) as name, arg_max(folder, (ts, seq)) as folder, arg_max(kind = 'removed', (ts, seq)) as is_trashed from k group by 1")
def stream_change_feed(v):
    scratch = Scratch(v.spark)
    feed = v("message").select(
        F.col("sender").alias("id"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("n"), (F.col("id") % 10).cast("string"))).alias("name"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("root/"), "channel")).otherwise("elsewhere").alias("folder"),
        F.when(F.col("id") % 11 == 0, "removed").when(F.col("id") % 13 == 0, "folder").otherwise("changed").alias("kind"), F.col("sent_at").alias("at"), F.col("id").alias("seq"),
    )
    catalog = KeyedTable(v.spark, scratch.path("catalog"), J.CATALOG, ["id"], buckets=8)
    J.available(_arrive(v, feed, scratch, "in", by="seq"), scratch.path("job"), each=J.change_feed(catalog, root="root"))
    catalog.vacuum()
    return catalog.latest().select("id", "name", "folder", "is_trashed")


@query("message", "project", sql="select distinct p.id, p.name from project p join message m on m.project_hint = p.id where m.channel = 'click'")
def stream_board_probe(v):
    scratch = Scratch(v.spark)
    stream = _arrive(v, v("message").filter("channel = 'click'").select("id", F.col("project_hint").alias("board")), scratch, "in")
    project = v("project").select("id", "name")
    J.available(stream, scratch.path("job"), each=J.board_probe(lambda boards: project.join(boards.withColumnRenamed("board", "id"), "id", "left_semi"), scratch.path("read")))
    return v.spark.read.parquet(scratch.path("read")).select("id", "name").distinct()


@query("message", sql="""
, w as (select max(sent_at) - interval 1 hour as w from message), l as (select sender, greatest(max(sent_at), any_value(w)) as seen from message, w group by 1),
h as (select m.sender, project_hint // 7 as p, sum(pow(0.5::double, (epoch(seen) - epoch(sent_at)) / 86400.0::double / 7.0::double)) as weight from message m join l using (sender) where sent_at >= seen - interval 14 day group by 1, 2),
u as (select *, sum(weight) over (partition by sender) as total from h), t as (select *, row_number() over (partition by sender order by round(weight / total, 9) desc, p) as k from u)
select l.sender, case when weight / total >= 0.6 then p end as project_id, coalesce(round(weight / total, 3), 0) as share from l left join t on t.sender = l.sender and k = 1""")
def stream_sender_attribution(v):
    """The votes when all messages are in and the watermark has passed on; messages go through the whole cascade."""
    scratch = Scratch(v.spark)
    message = v("message").select("id", "sender", "sent_at", F.floor(F.col("project_hint") / 7).alias("project_hint"), F.col("channel").alias("text"), F.unix_seconds(F.col("sent_at").cast("timestamp")).alias("second"))
    stream = _arrive(v, message, scratch, "in", by="second")
    defaults = message.filter("sender % 3 = 0").select("sender", (F.col("sender") % 20).alias("project_id")).distinct()
    out = scratch.path("out")
    J.available(J.sender_votes(stream), scratch.path("job"), mode="update", each=J.attribution(v("project"), defaults, out))
    seen = v.spark.read.parquet(f"{out}/votes")
    return seen.groupBy("sender").agg(F.max(F.struct("batch", "seen_at", "project_id", "share")).alias("m")).select("sender", F.col("m.project_id").alias("project_id"), F.round("m.share", 3).alias("share"))


@query("claim", sql=_CLUSTERS + "select project_id, cluster_key, members, status, chosen_id from cl")
def stream_consolidation(v):
    scratch = Scratch(v.spark)
    claims = v("claim")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in claims.schema)
    clusters = KeyedTable(v.spark, scratch.path("clusters"), J.CLAIM_CLUSTERS, ["project_id", "cluster_key"], buckets=8)
    stored = KeyedTable(v.spark, scratch.path("claims"), schema, J.CLAIM_GROUP, buckets=8)
    J.available(_arrive(v, claims, scratch, "in"), scratch.path("job"), each=J.consolidation(stored, clusters))
    return clusters.latest().select("project_id", "cluster_key", "members", "status", "chosen_id")


@query("message", sql="select s.step, s.outcome, (case when s.step = 'sync' then (select count(*) from message) when s.step = 'embed' then (select count(*) from message where channel = 'click') else 0 end)::bigint as n from (values ('sync', 'ok'), ('broken', 'failed: ZeroDivisionError'), ('embed', 'ok')) s(step, outcome)")
def stream_refresh(v):
    scratch = Scratch(v.spark)
    steps = [("sync", lambda b: b.count()), ("broken", lambda b: 1 // 0), ("embed", lambda b: b.filter("channel = 'click'").count())]
    J.available(_arrive(v, v("message").select("id", "channel"), scratch, "in"), scratch.path("job"), each=J.refresh(steps, scratch.path("outcome")))
    return v.spark.read.parquet(scratch.path("outcome")).groupBy("step", "outcome").agg(F.sum("n").alias("n"))
