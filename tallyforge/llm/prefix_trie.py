"""Conversation prefix trie by truncation peeling.

A conversation is its turns in order; every distinct sequence of first d turns is a
node of depth d. Peeling goes from the greatest depth down: at depth d the
conversations that end there are merged, by the digest of their d turns, with the
nodes that survive from depth d + 1, each stripped of its last turn. One grouping a
depth finds the nodes and adds up what stands below them: members, smallest member,
children, leaves and saved tokens. A node carries the digests of its turns (16 bytes
each), so stripping is a substring; groups are partly summed before they are
shuffled, and each depth is a written table that the next one reads.

A tail that no other conversation shares needs no peeling. Equal conversations are
first taken together; at every CHECK turns, digests are counted, and from the first
such depth that only one sequence reaches, the rest of it is written out at once, as
a chain whose figures are sums along it. Peeling starts at the deepest of these
places, so its rounds are those of the longest prefix that two different
conversations share (rounded up to CHECK), however long single conversations are.

``ends_sha256`` hashes the ids of the conversations that end at a node, in order.
Ids of a node with several are range-partitioned with the node, joined in parts of
PART ids, and the parts are streamed through one hash: a node where a third of all
conversations end costs a task the bytes of its ids and no list of them.

Defined results: null roles and texts count as empty; turns of one conversation are
ordered by turn, null first, equal turns by a digest of role and text, so repeated
rows are repeated turns; very long texts count whole, as digest and size; a
conversation, like a document, is one row of 24 bytes a turn; rows without an id
are of no conversation; an empty table has no node; other columns are ignored,
whatever their names. Digests are 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Every so many turns it is told whether a sequence goes on alone.
CHECK = 16
#: Ids joined into one part of a node's list.
PART = 50_000
NODE = "depth int, key binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turn_lists(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) with a conversation's turns in order, each a digest of role and text and the text's UTF-8 bytes."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = conversations[turn_col]
    rows = conversations.select(conversations[id_col].cast("long").alias("conv_id"), F.struct(turn.isNotNull().alias("later"), turn.alias("turn"), digest.alias("digest"), F.octet_length(text).alias("size")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(lists: DataFrame, head: Column, base: Column) -> DataFrame:
    """Each conversation with its first ``head`` turns taken from the conversation ``base`` (columns over conv_id)."""
    own = lists.select("conv_id", "turns", head.alias("h"), base.alias("base"))
    # A base lends its first turns to few conversations; they are cut before they are shuffled.
    most = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("first"))
    joined = own.join(most, "base", "left")
    first = F.slice(F.coalesce("first", F.array().cast(lists.schema["turns"].dataType)), 1, F.col("h"))
    rest = F.filter("turns", lambda t, i: i >= F.col("h"))
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


def chains(lists: DataFrame) -> DataFrame:
    """(conv_id, n, chain, bytes): the digests of the conversation's prefixes in one binary, 16 bytes a turn, and the bytes of the texts up to each turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1).to_pylist()
            out = []
            for digests in turns:
                key, parts = b"", []
                for d in digests:
                    key = hashlib.md5(key + d, usedforsecurity=False).digest()
                    parts.append(key)
                out.append(b"".join(parts))
            sums = [list(accumulate(sizes)) for sizes in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, turns), pa.int32()), pa.array(out, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], names=["conv_id", "n", "chain", "bytes"])

    flat = lists.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    return flat.mapInArrow(work, "conv_id long, n int, chain binary, bytes array<long>")


def _key(chain: str, depth: Column | int) -> Column:
    """The digest of the first ``depth`` turns; empty at depth 0."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth > 0, F.substring(F.col(chain), depth * 16 - 15, F.lit(16))).otherwise(F.substring(F.col(chain), F.lit(1), F.lit(0)))


def end_hashes(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(depth, key, ends_sha256) of the ids (conv_id) that end at each node (depth, key)."""
    counted = ends.groupBy("depth", "key").agg(F.count(F.lit(1)).alias("ids"), F.min("conv_id").alias("one"))
    counted = scratch.keep(counted, "end-counts")
    single = counted.filter("ids = 1").select("depth", "key", F.sha2(F.col("one").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = ends.join(counted.filter("ids > 1").select("depth", "key"), ["depth", "key"], "left_semi")
    ordered = several.select("depth", "key", "conv_id").repartitionByRange("depth", "key", "conv_id").sortWithinPartitions("depth", "key", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["depth", "key", "first", "ids"])

        for batch in batches:
            for depth, key, i in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if node != (depth, key) or len(ids) == PART:
                    if ids:
                        yield part()
                    node, ids = (depth, key), []
                ids.append(i)
        if ids:
            yield part()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.binary()), pa.array([state.hexdigest()])], names=["depth", "key", "ends_sha256"])

        for batch in batches:
            for depth, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if node == (depth, key):
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        yield row()
                    node, state = (depth, key), hashlib.sha256(ids.encode())
        if node is not None:
            yield row()

    parts = ordered.mapInArrow(join, "depth int, key binary, first long, ids string")
    hashed = parts.repartition("depth", "key").sortWithinPartitions("depth", "key", "first").mapInArrow(digest, "depth int, key binary, ends_sha256 string")
    return single.unionByName(hashed)


def _bytes_at(depth: Column) -> Column:
    """The bytes of the texts up to a depth."""
    return F.coalesce(F.get("bytes", depth - 1), F.lit(0).cast("long"))


def peeled(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of ``chains`` by truncation peeling: depth, key, parent key, and what is summed over members and subtree."""
    # Equal conversations are one run of several members.
    whole = runs.groupBy("n", _key("chain", F.col("n")).alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("members"), F.first("chain").alias("chain"), F.first("bytes").alias("bytes"))
    whole = scratch.keep(whole.drop("key"), "runs")
    longest = whole.agg(F.max("n").alias("n")).first()["n"]
    if longest is None:
        return whole.sparkSession.createDataFrame([], NODE)
    tails, n, none = None, F.col("n"), F.lit(0).cast("long")
    if longest > CHECK:
        # The first CHECK-th depth that a run reaches alone; from there on it is a chain.
        places = whole.filter(n >= CHECK).select("conv_id", F.explode(F.sequence(F.lit(CHECK), n, F.lit(CHECK))).alias("at"), "chain")
        alone = places.groupBy("at", _key("chain", F.col("at")).alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("runs")).filter("runs = 1")
        cuts = alone.groupBy("conv_id").agg(F.min("at").alias("cut"))
        whole = scratch.keep(whole.join(cuts, "conv_id", "left").withColumn("depth", F.coalesce("cut", "n")), "cut-runs")
        each = whole.filter("cut < n").select("conv_id", "members", "n", "chain", "bytes", F.explode(F.sequence(F.col("cut") + 1, n)).alias("depth"))
        depth = F.col("depth")
        tails = each.select(
            "depth", _key("chain", depth).alias("key"), _key("chain", depth - 1).alias("parent"), "conv_id", F.col("members").alias("n_convs"),
            F.when(depth < n, 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("members") - 1) * (_bytes_at(n) - _bytes_at(depth - 1))).alias("saved_tokens"),
        )
        longest = whole.agg(F.max("depth").alias("d")).first()["d"]
    else:
        whole = whole.withColumn("depth", n)
    # A cut run enters the peeling with what stands below it: one child and the bytes of its tail.
    below = F.when(F.col("depth") < n, 1).otherwise(0).cast("long")
    whole = whole.select("depth", "conv_id", "members", below.alias("children"), below.alias("leaves"), ((F.col("members") - 1) * (_bytes_at(n) - _bytes_at(F.col("depth")))).alias("saved"), "chain", "bytes")
    state = [c for c in whole.columns if c != "depth"]
    survivors, out = None, tails
    for depth in range(longest, -1, -1):
        # Here ``leaves`` counts those of the children; a node without any is one itself.
        found = whole.filter(F.col("depth") == depth).select(*state)
        if survivors is not None:
            found = found.unionByName(survivors)
        sums = found.groupBy(_key("chain", depth).alias("key")).agg(
            F.min("conv_id").alias("conv_id"), F.sum("members").alias("members"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
            F.first(F.substring("chain", 1, 16 * depth)).alias("chain"), F.first(F.slice("bytes", 1, depth)).alias("bytes"),
        )
        last = _bytes_at(F.lit(depth)) - _bytes_at(F.lit(depth - 1)) if depth else none
        found = sums.withColumns({"leaves": F.when(F.col("children") > 0, F.col("leaves")).otherwise(1).cast("long"), "saved": F.col("saved") + (F.col("members") - 1) * last})
        nodes = scratch.keep(found, f"peeled-{depth}")
        survivors = nodes.withColumn("children", F.lit(1).cast("long")).select(*state)
        parent = _key("chain", depth - 1) if depth else F.lit(None).cast("binary")
        named = nodes.select(F.lit(depth).alias("depth"), "key", parent.alias("parent"), "conv_id", F.col("members").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        out = named if out is None else out.unionByName(named)
    return out


def prefix_trie(lists: DataFrame) -> DataFrame:
    """Per node of the trie of ``lists`` (conv_id, turns): conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(lists.sparkSession)
    runs = scratch.keep(chains(lists), "chains")
    nodes = scratch.keep(peeled(runs, scratch), "nodes")
    ends = end_hashes(runs.select(F.col("n").alias("depth"), _key("chain", F.col("n")).alias("key"), "conv_id"), scratch)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # All nodes of depth 1 have the root as parent: one row, which needs no shuffle.
    low = nodes.filter("depth <= 1").join(F.broadcast(parents.filter("depth = 1").drop("parent")), "depth", "left")
    rest = nodes.filter("depth > 1").join(parents.filter("depth > 1"), ["depth", "parent"], "left")
    named = low.select(*nodes.columns, "parent_conv_id").unionByName(rest.select(*nodes.columns, "parent_conv_id"))
    out = named.join(ends, ["depth", "key"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie_sql() -> str:
    """DuckDB SQL for the trie of rebuilt conversations: every prefix of every conversation, grouped."""
    return """
with tab as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab),
ids as (select conv_id, conv_id - (conv_id % 5 + 5) % 5 as base,
  xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 9 as h
  from (select distinct conv_id from conversations where conv_id is not null), tab),
o as (select conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, strlen(coalesce(text, '')) as bytes, turn from conversations where conv_id is not null),
k as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as k from o),
r as (select ids.conv_id, 0 as part, k.k, digest, bytes from ids join k on k.conv_id = base and k.k <= h union all select conv_id, 1, k, digest, bytes from ids join k using (conv_id) where k > h),
l as (select conv_id, list(digest order by part, k) as ds, list(bytes order by part, k) as bs from r group by 1),
m as (select conv_id, d, array_to_string(ds[1:d], '') as key, case when d > 0 then array_to_string(ds[1:d - 1], '') end as parent, case when d > 0 then bs[d] else 0 end as bytes, d = coalesce(len(ds), 0) as ended
  from (select conv_id, coalesce(ds, []) as ds, coalesce(bs, []) as bs, unnest(range(0, coalesce(len(ds), 0) + 1)) as d from ids left join l using (conv_id))),
g as (select d, key, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as own, string_agg(conv_id::varchar, ',' order by conv_id) filter (ended) as ends from m group by 1, 2),
ch as (select d - 1 as d, parent as key, count(*) as n_children from g where d > 0 group by 1, 2),
w as (select g.*, coalesce(n_children, 0) as n_children from g left join ch using (d, key)),
up as (select m.d, m.key, sum(own) as saved, count(*) filter (n_children = 0) as n_leaves from w join m on m.conv_id = w.conv_id and m.d <= w.d group by 1, 2)
select w.conv_id, w.d::bigint as depth, p.conv_id as parent_conv_id, w.n_convs::bigint as n_convs, w.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from w join up using (d, key) left join g p on p.d = w.d - 1 and p.key = w.parent"""
