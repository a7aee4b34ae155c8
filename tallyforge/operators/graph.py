"""Schedule graphs, all projects at once.

Tasks are (project_id, id, …), edges (project_id, predecessor_id, successor_id).

Longest chains are found in one shuffle by project: a task takes the projects of its
partition in blocks and relaxes all their edges at once, level by level. Projects of
over MOST_ROWS tasks and edges are relaxed by joins instead, in which only tasks that
moved in the last round offer anything, and only moves are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import Scratch, shuffled
from .windows import distributed_rank

KEY = ["project_id", "id"]
#: Tasks and edges of a project that one task takes at most, and of a block of projects before it is worked on.
MOST_ROWS, BLOCK_ROWS = 500_000, 500_000


def cycle_check(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks left over after tasks without predecessors are removed again and again: those in or behind a cycle."""
    scratch = Scratch(tasks.sparkSession)
    left = scratch.keep(edges.join(tasks.select("project_id", F.col("id").alias("successor_id")), ["project_id", "successor_id"], "left_semi").select("project_id", "predecessor_id", "successor_id").distinct(), "edges0")
    n, k = left.count(), 0
    while n:
        blocked = left.select("project_id", F.col("successor_id").alias("predecessor_id")).distinct()
        k += 1
        kept = scratch.keep(left.join(blocked, ["project_id", "predecessor_id"], "left_semi").select("project_id", "predecessor_id", "successor_id"), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        left, before, n = kept, n, kept.count()
        if n == before:
            break
    return left.select("project_id", F.col("successor_id").alias("id")).distinct()


def acyclic(tasks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and edges without those that cycle_check names."""
    bad = cycle_check(tasks, edges)
    good = tasks.join(bad, KEY, "left_anti")
    ends = [good.select("project_id", F.col("id").alias(c)) for c in ("predecessor_id", "successor_id")]
    return good, edges.join(ends[0], ["project_id", "predecessor_id"], "left_semi").join(ends[1], ["project_id", "successor_id"], "left_semi")


def _relax(start: DataFrame, edges: DataFrame, frm: str, to: str, offer: Column, take: Callable[[Column, Column], Column]) -> DataFrame:
    """Repeat value(to) = take(value, max offer of its neighbours) until nothing moves. ``start`` has KEY, value and what the offer needs; values only grow.

    Each round joins the edges of the tasks that moved with what these offer, and writes
    the tasks that move by it: over all rounds, one row for each move.
    """
    scratch = Scratch(start.sparkSession)
    state = scratch.keep(start, "start")
    links = scratch.keep(edges.select("project_id", F.col(frm).alias("id"), F.col(to).alias("_to")), "links")
    front, rounds = state.filter("value is not null"), []
    latest = state
    while True:
        offered = links.join(front.withColumn("_offer", offer), KEY).groupBy("project_id", F.col("_to").alias("id")).agg(F.max("_offer").alias("_best"))
        moved = latest.join(offered.filter("_best is not null"), KEY).withColumn("_next", take(F.col("value"), F.col("_best")))
        moved = moved.filter(~F.col("_next").eqNullSafe(F.col("value"))).withColumn("value", F.col("_next")).select(*state.columns)
        front = scratch.keep(moved, f"moved{len(rounds)}")
        if not front.limit(1).count():
            break
        rounds.append(scratch.path(f"moved{len(rounds)}"))
        latest = _newest(state, rounds)
    return latest


def _newest(state: DataFrame, rounds: list[str]) -> DataFrame:
    """The state with the last move of each task."""
    moves = state.sparkSession.read.schema(state.schema).parquet(*rounds)
    rest = [c for c in state.columns if c not in KEY]
    # Values only grow, so the greatest is the last.
    last = moves.groupBy(*KEY).agg(F.max("value").alias("_value"))
    return state.join(last, KEY, "left").withColumn("value", F.coalesce("_value", "value")).select(*KEY, *rest)


def _chain_block(tasks: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Tasks (p, i, d, v) with what the longest chain before each lasts and varies (``before``, ``spread``), and ``back``, the row of the predecessor it comes from.

    The predecessor is the greatest id of those whose chain is longest, then varies most.
    """
    n = len(tasks)
    order = tasks.sort_values(["p", "i"], kind="stable").reset_index(drop=True)
    at = order.reset_index().rename(columns={"index": "row"})[["p", "i", "row"]]
    ends = edges.merge(at, left_on=["p", "a"], right_on=["p", "i"]).merge(at, left_on=["p", "b"], right_on=["p", "i"], suffixes=("_a", "_b"))
    source, target = ends["row_a"].to_numpy(), ends["row_b"].to_numpy()
    by_source = np.argsort(source, kind="stable")
    source, target = source[by_source], target[by_source]
    first = np.searchsorted(source, np.arange(n + 1))
    d, v = order["d"].to_numpy(dtype=np.float64), order["v"].to_numpy(dtype=np.float64)
    before, spread, back = np.zeros(n), np.zeros(n), np.full(n, -1)
    # Level by level: a task offers when all its predecessors have.
    waits = np.bincount(target, minlength=n)
    ready = np.flatnonzero(waits == 0)
    left = n
    while len(ready):
        left -= len(ready)
        size = first[ready + 1] - first[ready]
        edge = np.repeat(first[ready] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        to, frm = target[edge], np.repeat(ready, size)
        lasts, varies = before[frm] + d[frm], spread[frm] + v[frm]
        # The last of the offers to a task, in ascending order, is its best; rows ascend by id.
        best = np.lexsort((frm, varies, lasts, to))
        ends_at = np.flatnonzero(np.append(to[best][1:] != to[best][:-1], True)) if len(best) else np.zeros(0, dtype=np.int64)
        pick = best[ends_at]
        node, new = to[pick], (lasts[pick], varies[pick], frm[pick])
        better = (back[node] < 0) | (new[0] > before[node]) | ((new[0] == before[node]) & ((new[1] > spread[node]) | ((new[1] == spread[node]) & (new[2] > back[node]))))
        node = node[better]
        before[node], spread[node], back[node] = new[0][better], new[1][better], new[2][better]
        np.subtract.at(waits, to, 1)
        ready = np.unique(to[waits[to] == 0])
    if left:
        raise ValueError("the edges have a cycle: see cycle_check and acyclic")
    return order.assign(before=before, spread=spread, back=back)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Tasks (p, i, d, v) and edges (p, a, b) of whole projects, BLOCK_ROWS or one project at a time, from rows sorted by project."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            whole = pa.concat_tables(held)
            project = whole.column("p")
            last = project[-1]
            open_rows = pc.fill_null(pc.equal(project, last), False) if last.is_valid else pc.is_null(project)
            held = [whole.filter(open_rows)]
            rows = held[0].num_rows
            done = whole.filter(pc.invert(open_rows))
            if done.num_rows:
                yield _split(done)
    if held:
        yield _split(pa.concat_tables(held))


def _split(rows: pa.Table) -> tuple[pd.DataFrame, pd.DataFrame]:
    task = pc.is_null(rows.column("a"))
    return rows.filter(task).select(["p", "i", "d", "v"]).to_pandas(), rows.filter(pc.invert(task)).select(["p", "a", "b"]).to_pandas()


def _by_project(tasks: DataFrame, edges: DataFrame, frm: str, to: str, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``work`` over blocks of projects, and the tasks and edges of the projects that are too large for it."""
    id_type = tasks.schema["id"].dataType.simpleString()
    own = tasks.select(F.col("project_id").alias("p"), F.col("id").alias("i"), F.lit(None).cast(id_type).alias("a"), F.lit(None).cast(id_type).alias("b"), F.col("expected").cast("double").alias("d"), F.col("variance").cast("double").alias("v"))
    ends = edges.select(F.col("project_id").alias("p"), F.lit(None).cast(id_type).alias("i"), F.col(frm).cast(id_type).alias("a"), F.col(to).cast(id_type).alias("b"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("v")).distinct()
    rows = own.unionByName(ends)
    large = Scratch(tasks.sparkSession).keep(rows.groupBy(F.col("p").alias("project_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_ROWS).select("project_id"), "large")
    small = rows.join(large, rows["p"].eqNullSafe(large["project_id"]), "left_anti")

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, e in _blocks(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_pandas(work(t, e), schema=arrow, preserve_index=False)

    done = small.repartition("p").sortWithinPartitions("p").mapInArrow(run, schema)
    return done, tasks.join(large, "project_id", "left_semi"), edges.join(large, "project_id", "left_semi")


def _longest_before(tasks: DataFrame, edges: DataFrame, frm: str, to: str) -> DataFrame:
    """KEY, expected and ``value``, what the longest chain before each task lasts."""
    types = [tasks.schema[k].dataType.simpleString() for k in KEY]
    rows = tasks.select(*KEY, F.col("expected").cast("double").alias("expected")).withColumn("variance", F.lit(0.0))

    def work(t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        done = _chain_block(t, e)
        return pd.DataFrame({"project_id": done["p"], "id": done["i"], "expected": done["d"], "value": done["before"]})

    done, large, links = _by_project(rows, edges, frm, to, work, f"project_id {types[0]}, id {types[1]}, expected double, value double")
    # Written once: a pass is read by all that follow.
    done = Scratch(tasks.sparkSession).keep(done, "chains")
    if not large.limit(1).count():
        return done
    start = large.select(*KEY, "expected", F.lit(0.0).alias("value"))
    return done.unionByName(_relax(start, links, frm, to, F.col("value") + F.col("expected"), lambda v, o: F.greatest(v, o)).select(*done.columns))


def pert_estimates(tasks: DataFrame, *, low: str = "optimistic", likely: str = "likely", high: str = "pessimistic") -> DataFrame:
    """Expected duration, standard deviation and variance of three-point estimates; ``valid`` if low <= likely <= high and low >= 0."""
    o, m, p = F.col(low).cast("double"), F.col(likely).cast("double"), F.col(high).cast("double")
    sd = (p - o) / 6
    return tasks.withColumns({"expected": F.round((o + 4 * m + p) / 6, 6), "sd": F.round(sd, 6), "variance": F.round(sd * sd, 6), "valid": (o >= 0) & (o <= m) & (m <= p)})


def cpm_forward(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Early start and finish: a task starts when its last predecessor ends."""
    done = _longest_before(tasks, edges, "predecessor_id", "successor_id")
    return done.select(*KEY, "expected", F.col("value").alias("early_start"), (F.col("value") + F.col("expected")).alias("early_finish"))


def cpm_backward(forward: DataFrame, edges: DataFrame) -> DataFrame:
    """Late start and finish, total float, and whether a task is critical (float under 0.001)."""
    finish = forward.groupBy("project_id").agg(F.max("early_finish").alias("_end"))
    # The longest chain after a task, against the edges.
    after = _longest_before(forward, edges, "successor_id", "predecessor_id").select(*KEY, "value")
    late = forward.join(shuffled(after), KEY).join(shuffled(finish), "project_id").withColumn("late_finish", F.col("_end") - F.col("value"))
    out = late.withColumns({"late_start": F.col("late_finish") - F.col("expected"), "total_float": F.round(F.col("late_finish") - F.col("early_finish"), 6)})
    return out.withColumn("critical", F.abs("total_float") < 0.001).drop("value", "_end")


def free_float(schedule: DataFrame, edges: DataFrame) -> DataFrame:
    """Least early start of the successors less the early finish; the total float of tasks without successors."""
    nexts = edges.join(schedule.select("project_id", F.col("id").alias("successor_id"), "early_start"), ["project_id", "successor_id"]).groupBy("project_id", F.col("predecessor_id").alias("id")).agg(F.min("early_start").alias("_next"))
    return schedule.join(nexts, KEY, "left").withColumn("free_float", F.round(F.coalesce(F.col("_next") - F.col("early_finish"), F.col("total_float")), 6)).drop("_next")


#: Nodes (level, place) that cover the places lo to hi, and all nodes above those; the root of a project's places is at level ``top``.
_COVER = """aggregate(sequence(0, top), named_struct('l', lo, 'r', hi, 'out', cast(array() as array<struct<level: int, at: bigint>>)),
  (s, k) -> named_struct(
    'l', case when s.l > s.r then s.l else (s.l + 1) div 2 end, 'r', case when s.l > s.r then s.r else (s.r + 1) div 2 - 1 end,
    'out', concat(s.out, case when s.l > s.r then array() else array_compact(array(
      case when s.l % 2 = 1 then named_struct('level', k, 'at', s.l) end, case when s.r % 2 = 0 then named_struct('level', k, 'at', s.r) end)) end)),
  s -> s.out)"""
_ABOVE = "array_distinct(flatten(transform(filter(cover, c -> c.level < top), c -> transform(sequence(1, top - c.level), k -> named_struct('level', c.level + k, 'at', shiftright(c.at, k))))))"


def drag(schedule: DataFrame) -> DataFrame:
    """What a critical task adds to its project: its duration or, if less, the least float of the non-critical tasks that overlap it.

    The distinct times of a project are numbered, and an interval of time is cut into
    the few nodes of a binary tree of times that cover it. Two intervals overlap if and
    only if a node of one is a node of the other or above one. So the least float per
    node answers for all tasks: no pairs of tasks are formed, and a long project is
    partly reduced before it is shuffled.
    """
    # A time t stands at place 2 t, what lies before the next one at 2 t + 1: an interval is open, one without length a place.
    schedule = Scratch(schedule.sparkSession).keep(schedule.select(*KEY, "expected", "early_start", "early_finish", "critical", "total_float"), "schedule")
    ends = schedule.select("project_id", F.explode(F.array("early_start", "early_finish")).alias("time")).distinct()
    numbered = distributed_rank(ends, [F.asc("time")], by=("project_id",), name="place")
    at = lambda c: shuffled(numbered.select("project_id", F.col("time").alias(c), F.col("place").alias(f"_{c}")))
    tops = numbered.groupBy("project_id").agg(F.length(F.bin(F.max("place") * 2 + 1)).cast("int").alias("top"))
    placed = schedule.join(shuffled(tops), "project_id").join(at("early_start"), ["project_id", "early_start"]).join(at("early_finish"), ["project_id", "early_finish"])
    empty = F.col("_early_start") == F.col("_early_finish")
    placed = placed.withColumns({"lo": F.col("_early_start") * 2 + F.when(empty, 0).otherwise(1), "hi": F.col("_early_finish") * 2 - F.when(empty, 0).otherwise(1)})
    covered = Scratch(schedule.sparkSession).keep(placed.select(*KEY, "expected", "critical", "total_float", "top", F.expr(_COVER).alias("cover")), "cover").withColumn("above", F.expr(_ABOVE))
    other = covered.filter("not critical")
    nodes = lambda df, c: shuffled(df.select("project_id", F.explode(c).alias("node"), "total_float").groupBy("project_id", "node").agg(F.min("total_float").alias("_least")))
    crit = covered.filter("critical")
    inside = crit.select(*KEY, F.explode("cover").alias("node")).join(nodes(other.withColumn("both", F.array_distinct(F.concat("cover", "above"))), "both"), ["project_id", "node"])
    around = crit.select(*KEY, F.explode("above").alias("node")).join(nodes(other, "cover"), ["project_id", "node"])
    least = inside.unionByName(around).groupBy(*KEY).agg(F.min("_least").alias("_least"))
    return crit.join(shuffled(least), KEY, "left").select(*KEY, "expected", F.least("expected", F.coalesce("_least", "expected")).alias("drag"))


def crash_rank(drags: DataFrame) -> DataFrame:
    """Critical tasks by drag, with what to do about them."""
    band = F.when(F.col("drag") >= 5, "crash_first").when(F.col("drag") >= 2, "consider").when(F.col("drag") >= 0.5, "minor").otherwise("leave")
    return drags.withColumns({"rank": F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("drag"), "id")), "action": band})


def critical_path(schedule: DataFrame) -> DataFrame:
    return schedule.filter("critical").select(*KEY, "early_start", "early_finish").orderBy("project_id", "early_start", "id")


def fast_track(schedule: DataFrame, edges: DataFrame) -> DataFrame:
    """Critical tasks with critical predecessors that could overlap: the largest duration among those."""
    crit = schedule.filter("critical")
    before = edges.join(crit.select("project_id", F.col("id").alias("predecessor_id"), "expected"), ["project_id", "predecessor_id"]).groupBy("project_id", F.col("successor_id").alias("id")).agg(F.max("expected").alias("saving"), F.count(F.lit(1)).alias("predecessors"))
    return crit.select(*KEY).join(before, KEY)


def longest_path(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project one longest chain: (duration, variance, path); ties by variance, then by the greatest last task, the greatest before it, and so on.

    Chains are kept as back pointers; only the chain that wins is written out.
    """
    types = [tasks.schema[k].dataType.simpleString() for k in KEY]
    rows = tasks.select(*KEY, "expected", "variance")
    schema = f"project_id {types[0]}, duration double, variance double, path array<{types[1]}>"

    def work(t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        done = _chain_block(t, e)
        done = done.assign(lasts=done["before"] + done["d"], varies=done["spread"] + done["v"], row=np.arange(len(done)))
        last = done.sort_values(["p", "lasts", "varies", "row"], kind="stable").drop_duplicates("p", keep="last")
        back, ids, paths = done["back"].to_numpy(), done["i"].tolist(), []
        for row in last["row"].tolist():
            path = []
            while row >= 0:
                path.append(ids[row])
                row = back[row]
            paths.append(path[::-1])
        return pd.DataFrame({"project_id": last["p"], "duration": last["lasts"].round(6), "variance": last["varies"].round(6), "path": paths})

    done, large, links = _by_project(rows, edges, "predecessor_id", "successor_id", work, schema)
    if not large.limit(1).count():
        return done
    return done.unionByName(_longest_of_large(large, links).select(*done.columns))


def _longest_of_large(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """``longest_path`` by joins: chains are relaxed as (duration, variance), then pointers from the last task backwards are doubled until they mark one chain."""
    scratch = Scratch(tasks.sparkSession)
    own = [F.col("expected").cast("double").alias("d"), F.col("variance").cast("double").alias("v")]
    start = tasks.select(*KEY, *own, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("v")).alias("value"))
    through = F.struct((F.col("value.d") + F.col("d")).alias("d"), (F.col("value.v") + F.col("v")).alias("v"))
    done = scratch.keep(_relax(start, edges, "predecessor_id", "successor_id", through, lambda v, o: F.greatest(v, o)).withColumn("through", through), "chains")
    before = done.select("project_id", F.col("id").alias("predecessor_id"), F.col("through").alias("offer"))
    tight = edges.join(before, ["project_id", "predecessor_id"]).join(done.select("project_id", F.col("id").alias("successor_id"), "value"), ["project_id", "successor_id"]).filter("offer = value")
    back = tight.groupBy("project_id", F.col("successor_id").alias("id")).agg(F.max("predecessor_id").alias("back"))
    pointers = scratch.keep(done.select(*KEY).join(back, KEY, "left"), "back0")
    last = scratch.keep(done.groupBy("project_id").agg(F.max(F.struct("through", "id")).alias("m")), "last")
    # (id, away): tasks on the chain and their distance from its end.
    chain, step, k = scratch.keep(last.select("project_id", "m.id", F.lit(0).cast("long").alias("away")), "chain0"), 1, 0
    while True:
        further = chain.join(pointers, KEY).filter("back is not null").select("project_id", F.col("back").alias("id"), (F.col("away") + step).alias("away"))
        k += 1
        longer = scratch.keep(chain.unionByName(further), f"chain{k}")
        if longer.count() == chain.count():
            break
        far = pointers.select("project_id", F.col("id").alias("back"), F.col("back").alias("far"))
        pointers = scratch.keep(pointers.join(far, ["project_id", "back"], "left").select(*KEY, F.col("far").alias("back")), f"back{k}")
        chain, step = longer, step * 2
    path = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("away", "id")))), lambda x: x["id"])
    paths = chain.groupBy("project_id").agg(path.alias("path"))
    return last.join(paths, "project_id").select("project_id", F.round("m.through.d", 6).alias("duration"), F.round("m.through.v", 6).alias("variance"), "path")


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function by a five-term rational approximation (error under 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def finish_probability(paths: DataFrame, *, target: Column) -> DataFrame:
    """Chance that the longest chain ends by the target; 0 or 1 without variance."""
    sd = F.sqrt("variance")
    z = (target - F.col("duration")) / sd
    chance = F.when(sd > 0, normal_cdf(z)).when(target >= F.col("duration"), 1.0).otherwise(0.0)
    return paths.withColumns({"sd": F.round(sd, 6), "z": F.when(sd > 0, F.round(z, 6)), "probability": F.round(chance, 6)})


def blocking_predecessors(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose predecessor is neither done nor cancelled."""
    open_tasks = tasks.filter(~F.col("status").isin("DONE", "CANCELLED")).select("project_id", F.col("id").alias("predecessor_id"), F.col("title").alias("predecessor_title"))
    return edges.join(open_tasks, ["project_id", "predecessor_id"])


def schedule_conflicts(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose predecessor ends (end, else due date) after the successor starts, with the days."""
    ends = tasks.select("project_id", F.col("id").alias("predecessor_id"), F.coalesce("end_date", "due_date").alias("_end"))
    starts = tasks.select("project_id", F.col("id").alias("successor_id"), "start_date")
    joined = edges.join(ends, ["project_id", "predecessor_id"]).join(starts, ["project_id", "successor_id"])
    return joined.filter(F.col("_end") > F.col("start_date")).select("project_id", "predecessor_id", "successor_id", F.datediff("_end", "start_date").alias("days"))


def cascade_shift(tasks: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """New windows after new finishes (project_id, id, new_end): successors start no earlier than their predecessors end, spans stay, pushes ripple.

    The largest push holds everywhere; undated tasks neither move nor pass a push on;
    only tasks that moved are returned.
    """
    dated = tasks.filter("start_date is not null and end_date is not null")
    span = F.datediff("end_date", "start_date")
    start = dated.join(changes.select(*KEY, "new_end"), KEY, "left").select(*KEY, span.alias("span"), F.datediff("start_date", F.lit("1970-01-01")).alias("first"), F.datediff("new_end", F.lit("1970-01-01")).alias("fixed"), F.when(F.col("new_end").isNotNull(), F.datediff("new_end", F.lit("1970-01-01"))).alias("value"))
    # value: the pushed end of a task, null while it has not moved.
    take = lambda v, o: F.when(F.greatest(F.coalesce(v, F.lit(-1_000_000)), F.when(o > F.col("first"), o + F.col("span")).otherwise(-1_000_000)) > -1_000_000, F.greatest(F.coalesce(v, F.lit(-1_000_000)), F.when(o > F.col("first"), o + F.col("span")).otherwise(-1_000_000)))
    done = _relax(start, edges, "predecessor_id", "successor_id", F.col("value"), take).filter("value is not null")
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c)
    first = F.when(F.col("fixed").isNotNull() & (F.col("value") == F.col("fixed")), F.col("first")).otherwise(F.col("value") - F.col("span"))
    return done.select(*KEY, day(first.cast("int")).alias("new_start"), day(F.col("value").cast("int")).alias("new_end"))


def task_tree(tasks: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Depth, path and number of children of each task below its project's roots (project_id, id, parent_id), and its place in the tree.

    ``place`` numbers a project's tasks from 0 as the tree is read, parents before their
    children, siblings by ``order`` (columns of ``tasks``) and then id; ``last`` is the place
    of the last task below. So a task's descendants have their places in (place, last],
    its ancestors are those whose span holds its place. Ancestors are found by pointers
    that double each round: as many rounds as the depth has binary digits. Tasks in or
    below a cycle of parents, or below a parent that is not there, are not in the tree.
    """
    scratch = Scratch(tasks.sparkSession)
    key = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(order or [])], F.col("id").alias("id"))
    rows = scratch.keep(tasks.select(*KEY, "parent_id", F.array(key).alias("keys")), "tasks")
    # keys: from below ``up`` to the task itself; ``up`` is null at a root.
    state, k = rows.withColumnRenamed("parent_id", "up"), 0
    most = rows.count().bit_length() + 1
    while state.filter("up is not null").limit(1).count() and k < most:
        above = state.select("project_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("keys").alias("_keys"))
        rooted = state.filter("up is null")
        joined = state.filter("up is not null").join(above, ["project_id", "up"]).select(*KEY, F.col("_up").alias("up"), F.concat("_keys", "keys").alias("keys"))
        k += 1
        state = scratch.keep(rooted.unionByName(joined), f"up{k}")
    walked = state.filter("up is null").select(*KEY, "keys").withColumn("ids", F.transform("keys", lambda x: x["id"]))
    below = walked.select("project_id", F.explode("ids").alias("id")).groupBy(*KEY).agg((F.count(F.lit(1)) - 1).alias("_below"))
    children = rows.filter("parent_id is not null").groupBy("project_id", F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    placed = distributed_rank(walked, [F.asc("keys")], by=("project_id",), name="place").join(below, KEY).join(children, KEY, "left")
    path = F.array_join(F.transform("ids", lambda x: x.cast("string")), "/")
    return placed.select(*KEY, (F.size("ids") - 1).alias("depth"), path.alias("path"), F.coalesce("children", F.lit(0)).alias("children"), "place", (F.col("place") + F.col("_below")).alias("last"))


def task_neighbourhood(tasks: DataFrame, edges: DataFrame, tree: DataFrame) -> DataFrame:
    """What stands around each task: (project_id, id, relation, other_id, days), days for a conflict only.

    Relations: parent, child, sibling, blocked_by (a predecessor that is open),
    preceded_by (one that is done or cancelled), blocks, and conflict (a predecessor
    that ends after the task starts). ``tasks`` has parent_id, status and dates.
    """
    up = tasks.join(tree.select(*KEY), KEY, "left_semi").filter("parent_id is not null").select(*KEY, "parent_id")
    row = lambda df, name, other, days=F.lit(None).cast("int"): df.select(*KEY, F.lit(name).alias("relation"), F.col(other).alias("other_id"), days.alias("days"))
    siblings = up.join(up.select("project_id", "parent_id", F.col("id").alias("_other")), ["project_id", "parent_id"]).filter("id <> _other")
    before = edges.withColumnRenamed("successor_id", "id").join(tasks.select("project_id", F.col("id").alias("predecessor_id"), F.col("status").alias("_status")), ["project_id", "predecessor_id"])
    done = F.col("_status").isin("DONE", "CANCELLED")
    parts = [
        row(up, "parent", "parent_id"), row(up.select("project_id", F.col("parent_id").alias("id"), F.col("id").alias("_child")), "child", "_child"), row(siblings, "sibling", "_other"),
        row(before.filter(~done), "blocked_by", "predecessor_id"), row(before.filter(done), "preceded_by", "predecessor_id"), row(edges.withColumnRenamed("predecessor_id", "id"), "blocks", "successor_id"),
        row(schedule_conflicts(tasks, edges).withColumnRenamed("successor_id", "id"), "conflict", "predecessor_id", F.col("days")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
