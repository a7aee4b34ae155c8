"""Schedule graphs over the driver's tables: the lines of an order are the tasks of a project."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query

# Chains of one to seven tasks: SQL can walk every path.
_FWD = """, fp(project_id, id, ef) as (select project_id, id, duration from task union select e.project_id, e.successor_id, fp.ef + t.duration from fp join edge e on e.project_id = fp.project_id and e.predecessor_id = fp.id join task t on t.project_id = e.project_id and t.id = e.successor_id),
fwd as (select t.project_id, t.id, t.duration as expected, max(ef) - t.duration as early_start, max(ef) as early_finish from fp join task t using (project_id, id) group by 1, 2, 3)
"""
_BWD = _FWD + """, bp(project_id, id, tail) as (select project_id, id, 0 from task union select e.project_id, e.predecessor_id, bp.tail + t.duration from bp join edge e on e.project_id = bp.project_id and e.successor_id = bp.id join task t on t.project_id = bp.project_id and t.id = bp.id),
tails as (select project_id, id, max(tail) as tail from bp group by 1, 2), ends as (select project_id, max(early_finish) as e from fwd group by 1),
sch as (select f.*, e - tail as late_finish, e - tail - expected as late_start, e - tail - early_finish as total_float, e - tail - early_finish = 0 as critical from fwd f join tails using (project_id, id) join ends using (project_id))
"""
_DRAG = _BWD + """, drags as (select c.project_id, c.id, c.expected, least(c.expected, coalesce(min(o.total_float), c.expected)) as drag from sch c left join sch o on o.project_id = c.project_id and not o.critical and o.early_start < c.early_finish and c.early_start < o.early_finish where c.critical group by c.project_id, c.id, c.expected)
"""


def _tasks(v):
    return v("task").withColumn("expected", F.col("duration").cast("double"))


def _schedule(v):
    return G.cpm_backward(G.cpm_forward(_tasks(v), v("edge")), v("edge"))


def _dated(v):
    return v("task").withColumns({"end_date": F.date_add("start_date", F.col("duration")), "due_date": F.lit(None).cast("date")})


@query("task", "edge", sql="select e.project_id, predecessor_id, successor_id, p.title as predecessor_title from edge e join task p on p.project_id = e.project_id and p.id = predecessor_id where p.status not in ('DONE', 'CANCELLED')")
def blocking_predecessors(v):
    return G.blocking_predecessors(v("task"), v("edge"))


@query("task", "edge", sql="select e.project_id, predecessor_id, successor_id, date_diff('day', s.start_date, (p.start_date + interval 1 day * p.duration)::date)::int as days from edge e join task p on p.project_id = e.project_id and p.id = predecessor_id join task s on s.project_id = e.project_id and s.id = successor_id where (p.start_date + interval 1 day * p.duration)::date > s.start_date")
def schedule_conflicts(v):
    return G.schedule_conflicts(_dated(v), v("edge"))


@query("task", "edge", sql=""", c as (select project_id, min(id) as id from task group by 1), s as (select t.project_id, t.id, start_date, (start_date + interval 1 day * duration)::date as e, duration from task t),
pu(project_id, id, ne) as (select s.project_id, s.id, (s.e + interval 30 day)::date from s join c using (project_id, id) union select e.project_id, e.successor_id, (pu.ne + interval 1 day * s.duration)::date from pu join edge e on e.project_id = pu.project_id and e.predecessor_id = pu.id join s on s.project_id = e.project_id and s.id = e.successor_id where pu.ne > s.start_date)
select project_id, id, max(ne) as new_end from pu group by 1, 2""")
def cascade_shift(v):
    tasks = _dated(v)
    first = tasks.groupBy("project_id").agg(F.min(F.struct("id", "end_date")).alias("m")).select("project_id", "m.id", F.date_add("m.end_date", 30).alias("new_end"))
    return G.cascade_shift(tasks, v("edge"), first).select("project_id", "id", "new_end")


_TREE = """, r as (select project_id, id, start_date, case when id > 1 and exists (select 1 from task p where p.project_id = task.project_id and p.id = task.id // 2) then id // 2 end as parent_id from task),
w(project_id, id, depth, path, ids, keys) as (select project_id, id, 0, id::varchar, [id], [{'s': start_date, 'i': id}] from r where parent_id is null union all select r.project_id, r.id, w.depth + 1, concat(w.path, '/', r.id), list_append(w.ids, r.id), list_append(w.keys, {'s': r.start_date, 'i': r.id}) from w join r on r.project_id = w.project_id and r.parent_id = w.id)
"""


def _tree_tasks(v):
    task = v("task")
    up = task.select("project_id", F.col("id").alias("parent_id"))
    half = task.withColumn("parent_id", F.floor(F.col("id") / 2).cast("int"))
    known = half.filter("id > 1").join(up, ["project_id", "parent_id"], "left_semi").select("project_id", "id", "parent_id")
    return _dated(v).join(known, ["project_id", "id"], "left")


@query("task", sql=_TREE + """, pl as (select *, row_number() over (partition by project_id order by keys) - 1 as place from w)
select w.project_id, w.id, w.depth, w.path, coalesce(c.n, 0) as children, w.place, w.place + (select count(*) from w d where d.project_id = w.project_id and d.depth > w.depth and list_contains(d.ids, w.id)) as last
from pl w left join (select project_id, parent_id, count(*) as n from r where parent_id is not null group by 1, 2) c on c.project_id = w.project_id and c.parent_id = w.id""")
def task_tree(v):
    return G.task_tree(_tree_tasks(v), [F.col("start_date")])


@query("task", "edge", sql=_TREE + """, ed as (select e.project_id, p.id as p, s.id as s, p.status in ('DONE', 'CANCELLED') as done, date_diff('day', s.start_date, (p.start_date + interval 1 day * p.duration)::date)::int as days from edge e join task p on p.project_id = e.project_id and p.id = predecessor_id join task s on s.project_id = e.project_id and s.id = successor_id)
select project_id, id, 'parent' as relation, parent_id as other_id, null::int as days from r where parent_id is not null union all select project_id, parent_id, 'child', id, null from r where parent_id is not null
union all select a.project_id, a.id, 'sibling', b.id, null from r a join r b on a.project_id = b.project_id and a.parent_id = b.parent_id and a.id <> b.id
union all select project_id, s, case when done then 'preceded_by' else 'blocked_by' end, p, null from ed union all select project_id, p, 'blocks', s, null from ed union all select project_id, s, 'conflict', p, days from ed where days > 0""")
def task_neighbourhood(v):
    tasks = _tree_tasks(v)
    return G.task_neighbourhood(tasks, v("edge"), G.task_tree(tasks))


@query("task", sql="select project_id, id, round((floor(duration / 2) + 4 * duration + duration * 2) / 6, 6) as expected, round((duration * 2 - floor(duration / 2)) / 6, 6) as sd, round(pow((duration * 2 - floor(duration / 2)) / 6, 2), 6) as variance, true as valid from task")
def pert_estimates(v):
    tasks = v("task").select("project_id", "id", F.floor(F.col("duration") / 2).alias("optimistic"), F.col("duration").alias("likely"), (F.col("duration") * 2).alias("pessimistic"))
    return G.pert_estimates(tasks).select("project_id", "id", "expected", "sd", "variance", "valid")


@query("task", "edge", sql=_FWD + "select project_id, id, expected::double as expected, early_start::double as early_start, early_finish::double as early_finish from fwd")
def cpm_forward(v):
    return G.cpm_forward(_tasks(v), v("edge"))


@query("task", "edge", sql=_BWD + "select project_id, id, late_start::double as late_start, late_finish::double as late_finish, total_float::double as total_float, critical from sch")
def cpm_backward(v):
    return _schedule(v).select("project_id", "id", "late_start", "late_finish", "total_float", "critical")


@query("task", "edge", sql=_BWD + "select s.project_id, s.id, coalesce(min(n.early_start) - s.early_finish, s.total_float)::double as free_float from sch s left join edge e on e.project_id = s.project_id and e.predecessor_id = s.id left join sch n on n.project_id = e.project_id and n.id = e.successor_id group by s.project_id, s.id, s.early_finish, s.total_float")
def free_float(v):
    return G.free_float(_schedule(v), v("edge")).select("project_id", "id", "free_float")


@query("task", "edge", sql=_DRAG + "select project_id, id, expected::double as expected, drag::double as drag from drags")
def drag(v):
    return G.drag(_schedule(v))


@query("task", "edge", sql=_DRAG + "select project_id, id, drag::double as drag, row_number() over (partition by project_id order by drag desc, id)::int as rank, case when drag >= 5 then 'crash_first' when drag >= 2 then 'consider' when drag >= 0.5 then 'minor' else 'leave' end as action from drags")
def crash_rank(v):
    return G.crash_rank(G.drag(_schedule(v))).drop("expected")


@query("task", "edge", sql=_BWD + "select project_id, id, early_start::double as early_start, early_finish::double as early_finish from sch where critical")
def critical_path(v):
    return G.critical_path(_schedule(v))


@query("task", "edge", sql=_BWD + "select s.project_id, s.id, max(p.expected)::double as saving, count(*) as predecessors from sch s join edge e on e.project_id = s.project_id and e.successor_id = s.id join sch p on p.project_id = e.project_id and p.id = e.predecessor_id where s.critical and p.critical group by 1, 2")
def fast_track(v):
    return G.fast_track(_schedule(v), v("edge"))


_LONG = """, lp(project_id, id, d, vv, path) as (select project_id, id, duration::double, (duration / 4.0)::double, [id] from task union all select e.project_id, e.successor_id, lp.d + t.duration, lp.vv + (t.duration / 4.0)::double, list_append(lp.path, e.successor_id) from lp join edge e on e.project_id = lp.project_id and e.predecessor_id = lp.id join task t on t.project_id = e.project_id and t.id = e.successor_id),
best as (select * from lp qualify row_number() over (partition by project_id order by d desc, vv desc, list_reverse(path) desc) = 1)
"""


def _paths(v):
    return G.longest_path(_tasks(v).withColumn("variance", F.col("duration") / 4.0), v("edge"))


@query("task", "edge", sql=_LONG + "select project_id, d as duration, round(vv, 6) as variance, array_to_string(path, ',') as path from best")
def longest_path(v):
    return _paths(v).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))


@query("task", "edge", sql=_LONG + """, z as (select project_id, (d + project_id % 9 - 4 - d) / sqrt(vv) as z from best), u as (select *, 1 / (1 + 0.2316419::double * abs(z)) as t from z),
p as (select *, exp(-z * z / 2) * 0.3989422804014327::double * (t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double))))) as q from u)
select project_id, round(z, 6) as z, round(case when z >= 0 then 1 - q else q end, 6) as probability from p""")
def finish_probability(v):
    return G.finish_probability(_paths(v), target=F.col("duration") + F.col("project_id") % 9 - 4).select("project_id", "z", "probability")


@query("task", "edge", sql=""", hit as (select project_id, max(id) as top, min(id) as low from task where project_id % 10 = 0 group by 1 having count(*) > 1), r(project_id, id) as (select project_id, low from hit union select e.project_id, e.successor_id from r join edge e on e.project_id = r.project_id and e.predecessor_id = r.id)
, back as (select e.project_id, e.predecessor_id as p, e.successor_id as s from edge e union select project_id, top, low from hit), reach(project_id, a, b) as (select project_id, p, s from back union select x.project_id, x.a, y.s from reach x join back y on y.project_id = x.project_id and y.p = x.b)
, cyc as (select distinct project_id, a as id from reach where a = b) select project_id, id from cyc union select c.project_id, q.b from cyc c join reach q on q.project_id = c.project_id and q.a = c.id""")
def cycle_check(v):
    """Projects divisible by ten get an edge from their last task back to the first."""
    span = v("task").filter("project_id % 10 = 0").groupBy("project_id").agg(F.max("id").alias("predecessor_id"), F.min("id").alias("successor_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return G.cycle_check(v("task"), v("edge").unionByName(span))
