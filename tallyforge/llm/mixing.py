"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked in turn to target
marginals of sources, languages and topics. A document is kept with the
probability of its cell, its raked weight over its tokens, decided by a hash of
its id, so a re-run keeps the same documents. No probability passes 1: after every
round a cell's weight is cut to its tokens, and the next round moves what was cut
to the other cells, until the marginals hold. They can only hold for a total that
every category has the tokens for; without a given ``rate`` the total is the
largest of these, less a slack of 10 % that lets the rounds converge. Where the
marginals together still ask for tokens that are not there, a lower total may hold:
LOWERED totals, each LOWER times the one before, are raked side by side, and the
largest is taken whose marginals hold to MOST_ERROR. Marginals that contradict one
another (a source of one language with two different shares) hold at no total: raking
without cuts shows the error that is left however little is drawn, and the largest
total within MOST_ERROR of that is taken; if none is, that of the least error.
``marginals`` reports target, weight and error per category.

Every step is a DataFrame expression: documents are summed into cells before
anything is shuffled. Up to MOST_CELLS cells stand in one partition, where the
windows of the rounds need no shuffle; beyond, they shuffle.

Defined results: null sources, languages and topics are categories of their own;
a null text has 0 tokens; a cell without tokens has probability 1; repeated rows
are kept or dropped together, rows with a null id share one draw; very long texts
count whole; an empty table gives an empty one; all input columns return
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import numbered
from ..scratch import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: Without given targets a marginal is the tokens' own, flattened by this exponent.
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS = 12
#: Share of the largest feasible total that is drawn.
SLACK = 0.9
#: Relative error of a marginal at which a lower total is taken, by what factor it is lower, and how many totals are tried.
MOST_ERROR, LOWER, LOWERED = 0.01, 0.8, 12
#: Cells kept in one partition and broadcast to the documents at most.
MOST_CELLS = 100_000
#: Copies of the cells' probabilities, beyond MOST_CELLS, over which a hot cell's documents are dealt out.
SALTS = 64


def tokens(text: Column) -> Column:
    """White-space separated words of a text: the parts of a split, less an empty first and last one."""
    blank = [" ", "\t", "\n", "\x0b", "\f", "\r"]
    ends = F.substring(text, 1, 1).isin(blank).cast("long") + F.substring(text, -1, 1).isin(blank).cast("long")
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+")) - ends).cast("long")


def _times(text: Column, marks: str) -> Column:
    """How often the marks occur: byte searches, which cost little where a mark is rare."""
    left = text
    for m in marks:
        left = F.replace(left, F.lit(m), F.lit(""))
    return F.length(text) - F.length(left)


def topic(text: Column) -> Column:
    """A coarse default topic: tables, marked-up text, notes of a few lines, or prose."""
    pipes, marks, size = _times(text, "|"), _times(text, "#*$%&<>"), F.length(text)
    return F.when(text.isNull(), "none").when(pipes * 20 > size, "table").when(marks * 20 > size, "markup").when(size < 300, "note").otherwise("prose")


def _share(dimension: str, own: Column, targets: Mapping[str, Mapping[str, float]] | None) -> Column:
    """A category's target before it is scaled to a total."""
    if not targets or dimension not in targets:
        return F.pow(own, F.lit(FLATTEN[dimension]))
    share = F.lit(0.0)
    for name, value in targets[dimension].items():
        share = F.when(F.col(dimension) == name, float(value)).otherwise(share)
    return share


def calibrated_cells(cells: DataFrame, *, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``weight`` raked to the targets (``target_source`` and so on) and ``probability`` = weight / tokens, at most 1.

    The weights sum to ``rate`` of all tokens; None takes SLACK of the largest rate
    at which no category needs more tokens than it has, or a lower one of LOWERED.
    A few numbers per dimension and one error per total reach the driver.
    """
    scratch = Scratch(cells.sparkSession)
    start = scratch.keep(cells.select(*DIMENSIONS, "tokens"), "start")
    few = start.count() <= MOST_CELLS
    scale, limit, total = {}, None, 0.0
    for d in DIMENSIONS:
        own = F.col("own").cast("double")
        shares = start.groupBy(d).agg(F.sum("tokens").alias("own")).withColumn("share", _share(d, own, targets))
        row = shares.agg(F.sum("share").alias("s"), F.min(F.when(F.col("share") > 0, own / F.col("share"))).alias("least"), F.sum("own").alias("total")).first()
        scale[d], total = float(row["s"] or 0.0), float(row["total"] or 0.0)
        if row["least"] is not None and total:
            most = row["least"] * scale[d] / total
            limit = most if limit is None else min(limit, most)
    drawn = total * (rate if rate is not None else SLACK * min(limit or 0.0, 1.0))
    # Attempt j draws LOWER ** j of the total, cut to the tokens; attempt -1 is not cut.
    tried = [0] if rate is not None else [-1, *range(LOWERED)]
    out = start.withColumn("attempt", F.explode(F.array(*[F.lit(j) for j in tried])))
    out = out.repartition("attempt") if few else out
    goal = F.lit(drawn) * F.pow(F.lit(LOWER), F.greatest(F.col("attempt"), F.lit(0)))
    by = lambda d: Window.partitionBy("attempt", d)
    margin = lambda d: F.sum("weight").over(by(d))
    out = out.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        out = out.withColumn(f"target_{d}", goal * _share(d, F.sum("tokens").over(by(d)).cast("double"), targets) / F.lit(scale[d] or 1.0))
    for k in range(rounds):
        for d in DIMENSIONS:
            out = out.withColumn("weight", F.when(margin(d) > 0, F.col("weight") * F.col(f"target_{d}") / margin(d)).otherwise(F.col("weight")))
        out = out.withColumn("weight", F.when(F.col("attempt") >= 0, F.least("weight", F.col("tokens").cast("double"))).otherwise(F.col("weight")))
        if k % 6 == 5 and k < rounds - 1:
            out = scratch.keep(out, f"round{k}")
            out = out.repartition("attempt") if few else out
    off = [F.coalesce(F.abs(F.try_divide(margin(d), f"target_{d}") - 1), F.lit(0.0)) for d in DIMENSIONS]
    out = scratch.keep(out.withColumn("error", F.greatest(*off)), "raked")
    error = {r["attempt"]: r["e"] for r in out.groupBy("attempt").agg(F.max("error").alias("e")).collect()}
    allowed = max(MOST_ERROR, error.get(-1, 0.0) + MOST_ERROR if error.get(-1, 0.0) > MOST_ERROR else 0.0)
    within = [j for j in sorted(error) if j >= 0 and error[j] <= allowed]
    best = within[0] if within else min((j for j in error if j >= 0), key=lambda j: (error[j], j), default=0)
    scratch.drop("start", *[f"round{k}" for k in range(5, rounds - 1, 6)])
    probability = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    return out.filter(F.col("attempt") == best).select(*DIMENSIONS, "tokens", "weight", *[f"target_{d}" for d in DIMENSIONS], probability.alias("probability"))


def marginals(calibrated: DataFrame) -> DataFrame:
    """Per dimension and category of ``calibrated_cells``: tokens, target, weight and error (relative to the target; null where it is 0)."""
    parts = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category"), F.col(f"target_{d}").alias("target")).alias("p") for d in DIMENSIONS]
    each = calibrated.select(F.explode(F.array(*parts)).alias("p"), "tokens", "weight").select("p.*", "tokens", "weight")
    summed = each.groupBy("dimension", "category").agg(F.sum("tokens").alias("tokens"), F.first("target").alias("target"), F.sum("weight").alias("weight"))
    return summed.withColumn("error", F.abs(F.try_divide("weight", "target") - 1))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_expr: Column | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    rate: float | None = None,
    rounds: int = ROUNDS,
    seed: str = "mix",
    details: bool = False,
) -> DataFrame:
    """The sampled documents; with ``details`` every document's id, tokens, cell, probability and decision instead."""
    spark = docs.sparkSession
    own = docs if topic_expr is None else docs.withColumn("_topic_given", topic_expr)
    work, (key, text, source, lang) = numbered(own, id_col, text_col, source_col, lang_col)
    given = topic(F.col(text).cast("string")) if topic_expr is None else F.col(work.columns[-1])
    marked = work.withColumns({"_source": F.col(source).cast("string"), "_lang": F.col(lang).cast("string"), "_topic": given})
    names = {"_source": "source", "_lang": "lang", "_topic": "topic"}
    summed = marked.withColumn("_tokens", tokens(F.col(text).cast("string"))).groupBy(*names).agg(F.sum("_tokens").alias("tokens"))
    scratch = Scratch(spark)
    cells = scratch.keep(summed.withColumnsRenamed(names), "cells")
    factors = calibrated_cells(cells, targets=targets, rate=rate, rounds=rounds).select(*[F.struct(F.col(n).alias("v")).alias(f"_k{o}") for o, n in names.items()], F.col("probability").alias("_chance"))
    keyed = marked.withColumns({f"_j{o}": F.struct(F.col(o).alias("v")) for o in names})
    condition = [F.col(f"_j{o}") == F.col(f"_k{o}") for o in names]
    if cells.count() <= MOST_CELLS:
        joined = keyed.join(F.broadcast(factors), condition, "left")
    else:
        dealt = factors.withColumn("_ksalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col(key), F.length(F.col(text).cast("string"))), F.lit(SALTS)).cast("int")
        joined = keyed.withColumn("_jsalt", salt).join(dealt, [*condition, F.col("_jsalt") == F.col("_ksalt")], "left")
    chance = F.col("_chance")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(16**12)
    if details:
        return joined.select(
            F.col(key).alias(id_col), tokens(F.col(text).cast("string")).alias("n_tokens"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
            F.round(chance, 6).alias("probability"), (draw < chance).alias("kept"),
        )
    return joined.filter(draw < chance).select(*work.columns[: len(docs.columns)]).toDF(*docs.columns)


def mix_sql(rounds: int = ROUNDS, seed: str = "mix", source: str = "documents") -> str:
    """DuckDB SQL for ``mix(details=True)`` with default targets."""
    trimmed = r"regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
    sql = rf"""
with marked as (
  select doc_id, source, lang,
    case when text is null then 'none'
         when (length(text) - length(replace(text, '|', ''))) * 20 > length(text) then 'table'
         when (length(text) - length(translate(text, '#*$%&<>', ''))) * 20 > length(text) then 'markup'
         when length(text) < 300 then 'note' else 'prose' end as topic,
    case when coalesce(length({trimmed}), 0) = 0 then 0 else len(string_split_regex({trimmed}, '[\x20\x09-\x0D]+')) end as n_tokens
  from {source}),
cells as (select source, lang, topic, sum(n_tokens)::bigint as tokens from marked group by all),
shares as (select *, sum(tokens) over ()::double as total, {', '.join(f"sum(tokens) over (partition by {d})::double as o_{d}, pow(sum(tokens) over (partition by {d})::double, {FLATTEN[d]}) as s_{d}, count(*) over (partition by {d}) as n_{d}" for d in DIMENSIONS)} from cells),
scaled as (select *, {', '.join(f"sum(s_{d} / n_{d}) over () as z_{d}, min(case when s_{d} > 0 then o_{d} / s_{d} end) over () as l_{d}" for d in DIMENSIONS)} from shares),
drawn as (select *, total * {SLACK} * least(1.0, {', '.join(f"l_{d} * z_{d} / total" for d in DIMENSIONS)}) * pow({LOWER}, greatest(attempt, 0)) as goal from scaled, (select unnest(range(-1, {LOWERED}))::int as attempt)),
c0 as (select attempt, source, lang, topic, tokens, tokens::double as weight, {', '.join(f"goal * s_{d} / z_{d} as t_{d}" for d in DIMENSIONS)} from drawn)"""
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            cut = "case when attempt >= 0 then least(tokens::double, {0}) else {0} end" if d == DIMENSIONS[-1] else "{0}"
            raked = cut.format(f"case when m > 0 then weight * t_{d} / m else weight end")
            sql += f",\nc{k + 1} as (select * exclude (weight, m), {raked} as weight from (select *, sum(weight) over (partition by attempt, {d}) as m from c{k}))"
            k += 1
    off = ", ".join(f"coalesce(abs(sum(weight) over (partition by attempt, {d}) / nullif(t_{d}, 0) - 1), 0)" for d in DIMENSIONS)
    return sql + f""",
e as (select attempt, max(off) as error from (select attempt, greatest({off}) as off from c{k}) group by 1),
a as (select case when error > {MOST_ERROR} then error + {MOST_ERROR} else {MOST_ERROR} end as allowed from e where attempt = -1),
b as (select attempt as best from e, a where attempt >= 0 order by error > allowed, case when error > allowed then error end, attempt limit 1),
f as (select source, lang, topic, case when tokens > 0 then weight / tokens else 1.0 end as chance from c{k} join b on attempt = best)
select doc_id, n_tokens::bigint as n_tokens, m.source, m.lang, m.topic, round(chance, 6) as probability,
  ('0x' || substr(md5('{seed}/' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double / {16**12}.0 < chance as kept
from marked m left join f on m.source is not distinct from f.source and m.lang is not distinct from f.lang and m.topic is not distinct from f.topic"""
