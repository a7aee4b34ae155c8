"""Streams in several runs over one checkpoint, and tables that batches change."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import windows as W
from tallyforge.streaming import jobs as J
from tallyforge.streaming.tables import Conflict, KeyedTable

DAY0 = datetime(2024, 3, 1)


def files(folder):
    return sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True))


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id long, name string", ["id"], buckets=16)
    assert table.latest().count() == 0 and table.versions() == []
    table.upsert(0, spark.range(400).select("id", F.lit("a").alias("name")))
    whole = files(tmp_path)
    change = spark.createDataFrame([(3, "b"), (399, "b"), (1000, "c")], "id long, name string")
    assert table.upsert(1, change)
    written = set(files(tmp_path)) - set(whole)
    assert 0 < len({os.path.dirname(f) for f in written}) <= 3
    assert {(r.id, r.name) for r in table.latest().filter("name <> 'a'").collect()} == {(3, "b"), (399, "b"), (1000, "c")}
    assert table.latest().count() == 401 and table.at(0).count() == 400
    before = files(tmp_path)
    assert not table.upsert(1, spark.range(9).select("id", F.lit("z").alias("name")))
    assert files(tmp_path) == before and table.latest().filter("name = 'z'").count() == 0
    table.upsert(2, spark.createDataFrame([(3, "d")], "id long, name string"))
    gone = table.vacuum(keep=1)
    live = {f for f in files(tmp_path)}
    assert gone and table.versions() == [2] and table.latest().count() == 401
    assert {os.path.dirname(f) for f in live} == {f"{tmp_path}/t/data/version={v}/_bucket={b}" for b, parts in table.manifest(2).items() for v in parts}
    assert table.vacuum(keep=1) == []


def test_null_keys_deletes_and_wrong_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "a long, b string, n int", ["a", "b"], buckets=4)
    table.upsert(0, spark.createDataFrame([(1, None, 1), (None, None, 2), (1, "x", 3)], "a long, b string, n int"))
    table.upsert(1, spark.createDataFrame([(1, None, 10), (None, None, 20)], "a long, b string, n int"))
    assert sorted(r.n for r in table.latest().collect()) == [3, 10, 20]
    table.merge(2, spark.createDataFrame([(1, "x", 0)], "a long, b string, n int"), lambda old, new: old.join(new.select("a", "b"), ["a", "b"], "left_anti"))
    assert sorted(r.n for r in table.latest().collect()) == [10, 20]
    others = spark.range(50).select(F.col("id").alias("a"), F.lit("q").alias("b"), F.lit(1).alias("n"))
    with pytest.raises(ValueError):
        table.merge(3, spark.createDataFrame([(1, "x", 0)], "a long, b string, n int"), lambda old, new: others)
    assert table.versions() == [0, 1, 2]


def test_a_torn_manifest_is_no_commit_and_two_writers_conflict(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id long", ["id"], buckets=4)
    table.append(0, spark.range(5))
    with open(f"{tmp_path}/t/manifest/000000001", "w") as f:
        f.write('{"0": [1')
    assert table.versions() == [0]
    table.append(1, spark.range(5, 8))
    assert table.versions() == [0, 1] and table.latest().count() == 8
    with pytest.raises(Conflict):
        table._commit(1, {})


def test_appended_buckets_are_written_anew_in_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyforge.streaming.tables.MOST_PARTS", 3)
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id long", ["id"], buckets=1)
    for n in range(8):
        table.append(n, spark.range(n * 10, n * 10 + 10))
        assert len(table.manifest(n)[0]) <= 3
    assert sorted(r.id for r in table.latest().collect()) == list(range(80))


MESSAGE = "id long, sender long, sent_at timestamp, project_hint long, text string"


def message(i, sender, day, hint, text="rain"):
    return (i, sender, DAY0 + timedelta(days=day), hint, text)


def run_votes(spark, folder, projects, defaults):
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return J.available(J.sender_votes(stream, late="1 second"), f"{folder}/job", mode="update", each=J.attribution(projects, defaults, f"{folder}/out"))


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def latest_votes(spark, folder):
    seen = spark.read.parquet(f"{folder}/out/votes")
    best = seen.groupBy("sender").agg(F.max(F.struct("batch", "seen_at", "project_id", "share")).alias("m"))
    return {r.sender: (r.m.project_id, r.m.share) for r in best.collect()}


def test_votes_follow_the_batch_report_through_restarts(spark, tmp_path):
    folder = f"file://{tmp_path}"
    projects = spark.createDataFrame([(70, "Harbour house"), (71, "Mill")], "id long, name string")
    defaults = spark.createDataFrame([(3, 50)], "sender long, project_id long")
    batches = [
        [message(1, 1, 0, 7), message(2, 1, 1, 8), message(3, 1, 1.5, 7), message(4, 2, 1, 9), message(5, 3, 1.2, None, "to the mill")],
        [message(6, 1, 5, 8), message(7, 1, 5.5, 8), message(8, 2, 6, None), message(9, 4, 6, 5, "at Harbour House now")],
        [message(10, 1, 12, None), message(11, 3, 12.5, None)],
        [message(12, 5, 40, 1)],
        [message(13, 5, 41, 1)],
    ]
    everything = []
    for rows in batches:
        arrive(spark, folder, rows)
        everything += rows
        query = run_votes(spark, folder, projects, defaults)
        now = max(r[2] for r in everything)
        all_rows = spark.createDataFrame(everything, MESSAGE)
        want = {r.sender: (r.project_id, r.share) for r in W.recency_vote(all_rows, now=str(now)).collect()}
        got = latest_votes(spark, folder)
        assert {s: v for s, v in got.items() if v[0] is not None} == want
    attributed = {r.id: (r.target, r.method) for r in spark.read.parquet(f"{folder}/out/attributed").collect()}
    assert len(attributed) == len(everything)
    assert attributed[5] == (71, "text_match") and attributed[9] == (70, "text_match") and attributed[11] == (50, "worker_default")
    # At day 12 sender 1 has hints 7, 8, 7 of the first days and 8, 8 of day 5; at day 6 sender 2 has one hint.
    assert attributed[8] == (9, "sender_recency") and attributed[10] == (8, "sender_recency") and attributed[1] == (None, "unresolved")
    # Only sender 5 has spoken within the window: one list and one timer are left.
    state = spark.read.format("statestore").option("stateVarName", "hints").load(f"{folder}/job/checkpoint")
    assert {r.key[0] for r in state.select("key").collect()} == {5}
    assert query.lastProgress is not None


def test_messages_are_processed_once_and_failures_are_tried_again(spark, tmp_path):
    folder = f"file://{tmp_path}"
    schema = "id long, sent_at timestamp, body string"
    seen = KeyedTable(spark, f"{folder}/seen", "id long", ["id"], buckets=4)
    failures = KeyedTable(spark, f"{folder}/failures", schema + ", attempts int, error string, status string", ["id"], buckets=4)

    def each(row):
        if row["body"] == "bad" or (row["body"] == "flaky" and row["attempts"] == 0):
            raise ValueError("cannot read")

    step = J.intake(seen, failures, J.guarded(each), f"{folder}/outcome", most_attempts=3)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        J.available(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/job", each=step)

    day = lambda k: DAY0 + timedelta(days=k)
    run([(1, day(0), "ok"), (1, day(0), "ok"), (2, day(0), "bad"), (3, day(0), "flaky"), (None, day(0), "ok")])
    assert {(r.id, r.attempts, r.status, r.error) for r in failures.latest().collect()} == {(2, 1, "failed", "ValueError: cannot read"), (3, 1, "failed", "ValueError: cannot read")}
    # A second delivery of a failing message is no attempt of its own.
    run([(2, day(1), "bad"), (4, day(1), "ok")])
    run([(1, day(60), "ok"), (5, day(60), "ok")])
    run([(2, day(61), "bad")])
    outcome = spark.read.parquet(f"{folder}/outcome")
    assert {(r.id, r.status): r.n for r in outcome.groupBy("id", "status").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, "ok"): 1, (2, "failed"): 2, (2, "dead"): 1, (3, "failed"): 1, (3, "ok"): 1, (4, "ok"): 1, (5, "ok"): 1}
    assert {(r.id, r.attempts, r.status) for r in failures.latest().collect()} == {(2, 3, "dead")}
    assert sorted(r.id for r in seen.latest().collect()) == [1, 2, 3, 4, 5]
    # A batch that is run again after its commit changes nothing.
    before = files(tmp_path)
    step(spark.createDataFrame([(99, day(0), "ok")], schema), 0)
    assert files(tmp_path) == before
