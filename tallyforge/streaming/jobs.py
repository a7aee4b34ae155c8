"""Structured Streaming jobs: offsets and state live in a checkpoint, tables in a shared folder.

Each job takes a streaming DataFrame and the folder of its tables, and returns the
query it started; ``available`` runs a job over all that has arrived and ends.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.joins import sender_attribution
from ..operators.labour import consolidate_claims
from .tables import KeyedTable

#: Jobs with state of their own layout need the state store that has column families.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def available(stream: DataFrame, folder: str, *, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything that has arrived: into Parquet under ``folder``/out, or through ``each`` batch."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, STATE_STORE)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode(mode)
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{folder}/out").start()
        query.awaitTermination()
    finally:
        conf.set(key, before) if before else conf.unset(key)
    return query


def message_dedup(messages: DataFrame, *, key: str = "id", at: str = "sent_at", late: str = "2 days") -> DataFrame:
    """Each message id once; repeats within the watermark are dropped by state that the watermark clears."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_changes(events: DataFrame, *, at: str = "sent_at", kind: str = "channel", late: str = "1 day") -> DataFrame:
    """Daily tumbling counts by kind; a day is final when the watermark has passed it."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, "1 day"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("date").alias("day"), kind, "n")


def guarded(each: Callable[[dict], None], *, key: str = "id") -> Callable[[DataFrame], DataFrame]:
    """A step over rows from one over a row: (key, error), where error is null or the exception that ``each`` raised."""

    def run(rows: DataFrame) -> DataFrame:
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                errors = []
                for row in frame.to_dict("records"):
                    try:
                        each(row)
                        errors.append(None)
                    except Exception as error:  # the ledger is the report
                        errors.append(f"{type(error).__name__}: {error}")
                yield pd.DataFrame({key: frame[key], "error": pd.Series(errors, dtype=object)})

        return rows.mapInPandas(work, f"{key} {rows.schema[key].dataType.simpleString()}, error string")

    return run


def intake(seen: KeyedTable, failures: KeyedTable, process: Callable[[DataFrame], DataFrame], folder: str, *, key: str = "id", most_attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A batch step that processes each message id once, however late it comes again, and records failures.

    ``seen`` (key) has every id that is done or given up; ``failures`` (the message's
    columns, attempts, error, status) those whose processing raised an error, which
    every batch tries again up to ``most_attempts`` times in all. ``process`` takes the
    rows, with the attempts made so far, and gives (key, error). Outcomes are written
    to ``folder``/batch=n, what was tried to ``folder``_asked. A batch that stopped halfway is run again from the same
    tables; one that is in ``seen`` is done.
    """

    def step(batch: DataFrame, number: int) -> None:
        if number in seen.versions():
            return
        pending = failures.before(number)
        first = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        fresh = first.join(seen.held(first, number).select(key), key, "left_anti").join(pending.select(key), key, "left_anti")
        columns = [c for c in pending.columns if c not in ("attempts", "error", "status")]
        todo = fresh.select(*columns, F.lit(0).alias("attempts")).unionByName(pending.filter("status = 'failed'").select(*columns, "attempts"))
        # Written first: what is processed and what is recorded are the same rows.
        asked = f"{folder}_asked/batch={number}"
        todo.write.mode("overwrite").parquet(asked)
        todo = batch.sparkSession.read.schema(todo.schema).parquet(asked)
        status = F.when(F.col("error").isNull(), "ok").when(F.col("attempts") >= most_attempts, "dead").otherwise("failed")
        outcome = todo.withColumn("attempts", F.col("attempts") + 1).join(process(todo).select(key, "error"), key).withColumn("status", status)
        path = f"{folder}/batch={number}"
        outcome.write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.schema(outcome.schema).parquet(path)

        def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(key), key, "left_anti").unionByName(new.filter("status <> 'ok'").select(*old.columns))

        failures.merge(number, done.filter("status <> 'ok' or attempts > 1"), replaced)
        seen.append(number, done.filter("status <> 'failed'").select(key))

    return step


CATALOG = "id long, name string, folder string, is_trashed boolean, at timestamp, seq long"


def change_feed(catalog: KeyedTable, *, root: str) -> Callable[[DataFrame, int], None]:
    """A batch step that applies change events (id, name, folder, kind, at, seq) to the catalog, keyed by id.

    Removals delete softly; folders and what lies outside ``root`` are skipped; a
    null never overwrites; of one key the last event of a batch decides. Only the
    buckets of the ids in the batch are written.
    """

    def step(batch: DataFrame, number: int) -> None:
        kept = batch.filter((F.col("kind") != "folder") & ((F.col("kind") == "removed") | F.coalesce(F.col("folder").startswith(root), F.lit(False))))
        order = F.struct("at", "seq")
        last = kept.groupBy("id").agg(
            F.max_by("name", F.when(F.col("name").isNotNull(), order)).alias("_name"), F.max_by("folder", F.when(F.col("folder").isNotNull(), order)).alias("_folder"),
            F.max_by(F.col("kind") == "removed", order).alias("_gone"), F.max("at").alias("_at"), F.max("seq").alias("_seq"),
        )

        def apply(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new, "id", "full_outer").select(
                "id", F.coalesce("_name", "name").alias("name"), F.coalesce("_folder", "folder").alias("folder"), F.coalesce("_gone", "is_trashed").alias("is_trashed"), F.coalesce("_at", "at").alias("at"), F.coalesce("_seq", "seq").alias("seq"),
            )

        catalog.merge(number, last, apply)

    return step


def board_probe(reread: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A batch step that re-reads only the boards with activity in the batch (column board)."""

    def step(batch: DataFrame, number: int) -> None:
        reread(batch.select("board").distinct()).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return step


#: Stands for "no project leads" between Python and Spark, where a null whole number cannot.
NO_PROJECT = -1
DAY = 86_400_000_000


class SenderVotes(StatefulProcessor):
    """The dated project hints of a sender within a window, and the vote they give.

    State is one list of (time in microseconds, project). An event-time timer stands
    at the moment when the oldest hint leaves the window; a sender that stays silent is
    voted on once more for each hint that leaves, and keeps no state after the last.
    """

    def __init__(self, half_life_days: float, window_days: int, dominance: float):
        self.half_life, self.window, self.dominance = half_life_days * DAY, window_days * DAY, dominance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hints = handle.getListState("hints", "at long, project long")

    def _vote(self, held: dict[int, list], now: int) -> tuple[int, float]:
        # Weights are those of a fixed time: all fade alike, so shares do not depend on it.
        total = sum(w for w, _ in held.values())
        if not total:
            return NO_PROJECT, 0.0
        best = min(held, key=lambda p: (-round(held[p][0] / total, 9), p))
        share = round(held[best][0] / total, 4)
        return (best if share >= self.dominance else NO_PROJECT), share

    def _settle(self, key: tuple, hints: list[tuple[int, int]], now: int) -> dict:
        """Keep the hints of the window before ``now`` as state, set the timer, and give the sender's vote."""
        hints = [h for h in hints if h[0] >= now - self.window]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if hints:
            self.hints.put(hints)
            # A timer fires when the watermark has reached it: a millisecond after the hint has left.
            self.handle.registerTimer((hints[0][0] + self.window) // 1000 + 1)
        else:
            self.hints.clear()
        held: dict[int, list] = {}
        for at, project in hints:
            own = held.setdefault(project, [0.0, 0])
            own[0] += 2.0 ** ((at - now) / self.half_life)
            own[1] += 1
        project, share = self._vote(held, now)
        return {"kind": "vote", "id": None, "sender": key[0], "text": None, "project_id": project, "share": share, "seen_at": pd.Timestamp(now, unit="us")}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(["sent_at", "id"])
        hints = sorted(tuple(h) for h in self.hints.get())
        # Each message gets the vote of the hints before it: a window that slides over old and new ones.
        start = frame["sent_at"].iloc[0].value // 1000
        held: dict[int, list] = {}
        inside: deque[tuple[int, int]] = deque()

        def add(at: int, project: int) -> None:
            inside.append((at, project))
            own = held.setdefault(project, [0.0, 0])
            own[0] += 2.0 ** ((at - start) / self.half_life)
            own[1] += 1

        waiting = deque(hints)
        out = []
        for i, at, hint, text in zip(frame["id"], frame["sent_at"], frame["project_hint"], frame["text"]):
            now = at.value // 1000
            while waiting and waiting[0][0] <= now:
                add(*waiting.popleft())
            while inside and inside[0][0] < now - self.window:
                gone, project = inside.popleft()
                own = held[project]
                own[0] -= 2.0 ** ((gone - start) / self.half_life)
                own[1] -= 1
                if not own[1]:
                    del held[project]
            project, share = self._vote(held, now)
            out.append({"kind": "message", "id": int(i), "sender": key[0], "text": text, "project_id": project, "share": share, "seen_at": at})
            if not pd.isna(hint):
                insort(hints, (now, int(hint)))
                add(now, int(hint))
        latest = max(frame["sent_at"].iloc[-1].value // 1000, hints[-1][0] if hints else 0, timerValues.getCurrentWatermarkInMs() * 1000)
        out.append(self._settle(key, hints, latest))
        yield pd.DataFrame(out).astype({"id": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self._settle(key, sorted(tuple(h) for h in self.hints.get()), timerValues.getCurrentWatermarkInMs() * 1000)
        yield pd.DataFrame([row]).astype({"id": "Int64"})

    def close(self) -> None:
        pass


def sender_votes(messages: DataFrame, *, half_life_days: float = 7.0, window_days: int = 14, dominance: float = 0.6, late: str = "1 hour") -> DataFrame:
    """Votes over dated hints (id, sender, sent_at, project_hint, text), kept as state for ``window_days``.

    Per message (kind ``message``) the project that leads the vote of its sender's
    hints before it, and per sender (kind ``vote``) the vote whenever it changes: after a
    batch with messages of the sender, and when time takes a hint out of the window. A
    vote is that of ``recency_vote`` at ``seen_at``, the later of the sender's last message
    and the watermark. A null hint votes for nothing. A project needs ``dominance`` of
    the weight to lead; its share is given in any case.
    """
    votes = messages.select("id", "sender", "sent_at", "project_hint", "text").withWatermark("sent_at", late).groupBy("sender").transformWithStateInPandas(
        statefulProcessor=SenderVotes(half_life_days, window_days, dominance), outputStructType="kind string, id long, sender long, text string, project_id long, share double, seen_at timestamp", outputMode="Update", timeMode="EventTime",
    )
    return votes.withColumn("project_id", F.nullif("project_id", F.lit(NO_PROJECT)))


def attribution(projects: DataFrame, defaults: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """A batch step over ``sender_votes``: each message to a project by name, word, sender's default or vote, into ``folder``/attributed; the votes into ``folder``/votes."""

    def step(batch: DataFrame, number: int) -> None:
        path = f"{folder}/answers/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        answers = batch.sparkSession.read.schema(batch.schema).parquet(path)
        messages = answers.filter("kind = 'message'")
        found = sender_attribution(messages.select("id", "sender", "text"), projects, defaults, messages.select("id", "project_id"), vote_key="id")
        found.withColumnRenamed("key", "id").write.mode("overwrite").parquet(f"{folder}/attributed/batch={number}")
        answers.filter("kind = 'vote'").select("sender", "project_id", "share", "seen_at").write.mode("overwrite").parquet(f"{folder}/votes/batch={number}")

    return step


CLAIM_CLUSTERS = "project_id long, cluster_key string, worker_key string, work_date date, members long, channels long, status string, confidence double, chosen_id long, hours decimal(7,2)"


#: What tells the (worker, day) group of a claim.
CLAIM_GROUP = ["worker_id", "employee_name_raw", "work_date"]


def consolidation(claims: KeyedTable, clusters: KeyedTable) -> Callable[[DataFrame, int], None]:
    """A batch step that adds claims (keyed by CLAIM_GROUP) and clusters anew only the groups they touch (keyed by project_id, cluster_key)."""

    def step(batch: DataFrame, number: int) -> None:
        columns = batch.sparkSession.createDataFrame([], claims.schema).columns
        claims.append(number, batch.select(*columns))
        stored = claims.near(batch, number)
        touched = batch.select(*CLAIM_GROUP).distinct()
        again = consolidate_claims(stored.join(touched, [stored[k].eqNullSafe(touched[k]) for k in CLAIM_GROUP], "left_semi"))
        clusters.upsert(number, again.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in CLAIM_CLUSTERS.split(", ")]))

    return step


def refresh(steps: Iterable[tuple[str, Callable[[DataFrame], int]]], folder: str) -> Callable[[DataFrame, int], None]:
    """A batch step that runs named steps in order, each on its own: a failed one is recorded and does not undo or stop the others."""
    named = list(steps)

    def step(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        rows = []
        for order, (name, run) in enumerate(named):
            try:
                rows.append((number, order, name, "ok", int(run(held))))
            except Exception as error:  # noqa: PERF203  the outcome table is the report
                rows.append((number, order, name, f"failed: {type(error).__name__}", 0))
        held.unpersist()
        batch.sparkSession.createDataFrame(rows, "batch long, step_order int, step string, outcome string, n long").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return step
