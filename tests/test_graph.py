"""Chains, drag, trees and twins against plain loops, small and large projects alike."""

import datetime
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import graph as G
from tallyforge.operators import joins as J


def network(rng, projects=6, n=25):
    tasks, edges = [], []
    for p in range(projects):
        ids = rng.sample(range(2**60, 2**60 + 1000), n)
        tasks += [(p, i, float(rng.randint(0, 5)), float(rng.randint(0, 2))) for i in ids]
        edges += [(p, ids[a], ids[b]) for b in range(n) for a in range(b) if rng.random() < 0.12]
    return tasks, edges


def chains(tasks, edges):
    """Per task: the best (duration, variance, reversed path) that ends with it."""
    own = {(p, i): (d, v) for p, i, d, v in tasks}
    before = defaultdict(list)
    for p, a, b in edges:
        before[p, b].append((p, a))
    best = {}

    def walk(k):
        if k not in best:
            options = [walk(a) for a in before[k]]
            top = max(options, default=(0.0, 0.0, ()), key=lambda x: (x[0], x[1], x[2]))
            best[k] = (top[0] + own[k][0], top[1] + own[k][1], (k[1], *top[2]))
        return best[k]

    for k in own:
        walk(k)
    return best


@pytest.mark.parametrize("most, block", [(500_000, 500_000), (500_000, 40), (0, 10), (60, 10)])
def test_chains_of_small_and_large_projects(spark, monkeypatch, most, block):
    monkeypatch.setattr(G, "MOST_ROWS", most)
    monkeypatch.setattr(G, "BLOCK_ROWS", block)
    tasks, edges = network(random.Random(4))
    t = spark.createDataFrame(tasks, "project_id int, id long, expected double, variance double")
    e = spark.createDataFrame(edges, "project_id int, predecessor_id long, successor_id long")
    best = chains(tasks, edges)
    forward = G.cpm_forward(t, e)
    assert {(r.project_id, r.id): r.early_finish for r in forward.collect()} == {k: v[0] for k, v in best.items()}
    after = chains(tasks, [(p, b, a) for p, a, b in edges])
    end = {p: max(v[0] for k, v in best.items() if k[0] == p) for p in range(6)}
    assert {(r.project_id, r.id): r.late_start for r in G.cpm_backward(forward, e).collect()} == {k: end[k[0]] - v[0] for k, v in after.items()}
    want = {}
    for p in range(6):
        d, v, path = max(x for k, x in best.items() if k[0] == p)
        want[p] = (d, v, list(path[::-1]))
    assert {r.project_id: (r.duration, r.variance, r.path) for r in G.longest_path(t, e).collect()} == want


def test_a_long_chain_writes_each_move_once(spark, monkeypatch):
    from tallyforge import scratch

    n, written = 40, []
    monkeypatch.setattr(G, "MOST_ROWS", 0)
    keep = scratch.Scratch.keep
    monkeypatch.setattr(scratch.Scratch, "keep", lambda self, df, name: (written.append(name), keep(self, df, name))[1])
    t = spark.createDataFrame([(1, i, 1.0) for i in range(n)], "project_id int, id int, expected double")
    e = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)], "project_id int, predecessor_id int, successor_id int")
    start = t.withColumn("value", F.lit(0.0))
    moves = []
    newest = G._newest
    monkeypatch.setattr(G, "_newest", lambda state, rounds: (moves.append(spark.read.parquet(rounds[-1]).count()), newest(state, rounds))[1])
    done = G._relax(start, e, "predecessor_id", "successor_id", F.col("value") + F.col("expected"), lambda v, o: F.greatest(v, o))
    assert {r.id: r.value for r in done.collect()} == {i: float(i) for i in range(n)}
    # All tasks of the chain but those that are done move in a round of this one: n - 1, n - 2, …
    assert moves == list(range(n - 1, 0, -1)) and len([w for w in written if w.startswith("moved")]) == n


def test_chains_of_a_thousand_tasks_and_a_cycle(spark):
    n = 1000
    t = spark.createDataFrame([(p, i, 1.0) for p in (1, 2) for i in range(n)], "project_id int, id int, expected double")
    e = spark.createDataFrame([(p, i, i + 1) for p in (1, 2) for i in range(n - 1)], "project_id int, predecessor_id int, successor_id int")
    assert {r.id: r.early_finish for r in G.cpm_forward(t, e).filter("project_id = 2").collect()} == {i: i + 1.0 for i in range(n)}
    around = e.unionByName(spark.createDataFrame([(1, n - 1, 0)], e.schema))
    with pytest.raises(Exception, match="cycle"):
        G.cpm_forward(t, around).collect()


def plain_drag(rows):
    out = {}
    for p, i, d, s, f, slack, critical in rows:
        if critical:
            over = [x[5] for x in rows if x[0] == p and not x[6] and x[3] < f and s < x[4]]
            out[p, i] = min([d, *over])
    return out


def test_drag_is_the_least_overlapping_float(spark):
    rng = random.Random(9)
    rows = []
    for p in range(4):
        for i in range(40):
            s, d = float(rng.choice([0.0, 0.5, 1.25, 3, 7, 8, 20.5, 33]) + rng.randint(0, 3)), float(rng.randint(0, 9))
            rows.append((p, i, d, s, s + d, float(rng.randint(1, 6)), rng.random() < 0.4))
    df = spark.createDataFrame(rows, "project_id int, id int, expected double, early_start double, early_finish double, total_float double, critical boolean")
    assert {(r.project_id, r.id): r.drag for r in G.drag(df).collect()} == plain_drag(rows)
    assert G.drag(df.limit(0)).count() == 0


def test_drag_in_one_project_of_many_tasks(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("project_id"), "id", F.lit(3.0).alias("expected"), F.col("id").cast("double").alias("early_start"), (F.col("id") + 3.0).alias("early_finish"), (F.col("id") % 7 / 2 + 1).alias("total_float"), (F.col("id") % 2 == 0).alias("critical"))
    got = {r.id: r.drag for r in G.drag(df).filter("id % 997 = 0").collect()}
    for i, value in got.items():
        over = [j % 7 / 2 + 1 for j in range(max(0, i - 2), min(n, i + 3)) if j % 2]
        assert value == min([3.0, *over])


def test_trees_are_read_in_order_and_deep(spark):
    rng = random.Random(5)
    rows, parent = [], {}
    for p in range(3):
        for i in range(60):
            parent[p, i] = rng.randrange(i) if i and rng.random() < 0.9 else None
            rows.append((p, i, parent[p, i], rng.randint(0, 3)))
    chain = [(9, i, i - 1 if i else None, 0) for i in range(500)]
    lost = [(8, 1, 2, 0), (8, 2, 1, 0), (8, 3, 99, 0), (8, 4, None, 0)]
    df = spark.createDataFrame(rows + chain + lost, "project_id int, id int, parent_id int, start int")
    got = {(r.project_id, r.id): r for r in G.task_tree(df, [F.col("start")]).collect()}
    assert {k for k in got if k[0] == 8} == {(8, 4)}
    assert got[9, 499].depth == 499 and got[9, 0].last == 499 and got[9, 200].path == "/".join(map(str, range(201)))
    start = {(p, i): s for p, i, _, s in rows}
    for p in range(3):
        kids = defaultdict(list)
        for i in range(60):
            kids[parent[p, i]].append(i)
        seen = []

        def emit(i, path):
            place = len(seen)
            seen.append(i)
            for c in sorted(kids[i], key=lambda c: (start[p, c], c)):
                emit(c, [*path, c])
            r = got[p, i]
            assert (r.place, r.last, r.depth, r.path, r.children) == (place, len(seen) - 1, len(path) - 1, "/".join(map(str, path)), len(kids[i]))

        for root in sorted(kids[None], key=lambda c: (start[p, c], c)):
            emit(root, [root])


def plain_twins(rows, window):
    used, out = set(), set()
    for s in sorted((r for r in rows if not r[4]), key=lambda r: (r[5], r[0])):
        for o in sorted((r for r in rows if r[4]), key=lambda r: (r[5], r[0])):
            if o[0] not in used and (abs(o[1]), o[2], o[3]) == (abs(s[1]), s[2], s[3]) and abs((o[5] - s[5]).days) <= window:
                used.add(o[0])
                out.add((s[0], o[0], abs((o[5] - s[5]).days)))
                break
    return out


RECEIPT = "id long, total decimal(14,2), is_refund boolean, project_id long, online boolean, sales_date date, duplicate_of long"


@pytest.mark.parametrize("window", [0, 2, 5])
def test_twins_are_those_of_a_plain_loop(spark, window):
    rng = random.Random(window)
    day = datetime.date(2026, 1, 1)
    rows = [(i, Decimal(rng.choice([10, -10, 20])), rng.random() < 0.2, rng.choice([1, None]), rng.random() < 0.5, day + datetime.timedelta(rng.randint(0, 20)), None) for i in rng.sample(range(9999), 300)]
    got = {(r.primary, r.duplicate, r.days) for r in J.duplicate_twins(spark.createDataFrame(rows, RECEIPT), day_window=window).collect()}
    assert got == plain_twins(rows, window) and got


def test_twins_of_one_amount_without_a_project(spark):
    n = 200_000
    df = spark.range(n).select("id", F.lit(5).cast("decimal(14,2)").alias("total"), F.lit(False).alias("is_refund"), F.lit(None).cast("long").alias("project_id"), (F.col("id") % 2 == 1).alias("online"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("sales_date"), F.lit(None).cast("long").alias("duplicate_of"))
    # In-store rows on even days, as many online rows on odd ones: each day but the last takes the day before, or the next.
    found = J.duplicate_twins(df, day_window=1)
    assert found.count() == n // 2 and found.select("duplicate").distinct().count() == n // 2 and found.filter("days > 1").count() == 0


def test_joins_of_drag_and_of_edges_shuffle_however_small_the_files_are(spark, tmp_path, monkeypatch):
    """Millions of like rows are a few MB of Parquet, which Spark would send to the driver to broadcast."""
    from tallyforge import adapters, scratch

    plans = {}
    keep = scratch.Scratch.keep
    monkeypatch.setattr(scratch.Scratch, "keep", lambda self, df, name: (plans.update({name: df}), keep(self, df, name))[1])
    t = spark.createDataFrame([(p, i, 1.0) for p in range(9) for i in range(3)], "project_id int, id int, expected double")
    e = spark.createDataFrame([(p, i, i + 1) for p in range(9) for i in range(2)], "project_id int, predecessor_id int, successor_id int")
    plans["drag"] = G.drag(G.cpm_backward(G.cpm_forward(t, e), e))
    lines = spark.range(30).selectExpr("id div 3 as l_orderkey", "cast(id % 3 as int) as l_linenumber", "1.0d as l_quantity", "timestamp '1998-01-01' as l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    plans["edge"] = adapters.view(spark, str(tmp_path), "edge")
    plan = {k: df._jdf.queryExecution().sparkPlan().toString() for k, df in plans.items()}
    # What rests on the projects of over MOST_ROWS rows alone is small at any size.
    joins = {k: text.count("BroadcastHashJoin") for k, text in plan.items() if k != "chains"}
    assert {"schedule", "cover", "drag", "edge"} <= set(joins) and not any(joins.values())
    assert plans["drag"].count() == 27 and plans["edge"].count() == 30
