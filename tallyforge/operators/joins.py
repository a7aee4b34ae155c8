"""Joins and identity resolution.

Every resolver keeps one rule: a wrong link is worse than none. A strategy gives
candidates; ``precedence_join`` takes the first strategy with a hit, and where a
strategy asks for it, only a unique one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import civic_numbers, normalize_job, normalize_name, prefix_candidates, street_signature
from ..scratch import Scratch, shuffled
from .textjoin import contained, contained_targets, matching_ratio, near_texts
from .windows import distributed_rank


def docs_with_text(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents that are not in the trash, with their text where there is one."""
    return documents.filter(~F.col("is_trashed")).join(texts.filter("text is not null").withColumnRenamed("document_id", "id"), "id")


def docs_missing_text(documents: DataFrame, texts: DataFrame) -> DataFrame:
    return documents.join(texts.select(F.col("document_id").alias("id")), "id", "left_anti")


def missing_documents(projects: DataFrame, documents: DataFrame, placeholders: DataFrame, *, pattern: str, statuses: Sequence[str] = ("ACTIVE", "PROPOSED")) -> DataFrame:
    """Live projects without any document whose name has the pattern, but for placeholders."""
    have = documents.filter(~F.col("is_trashed") & F.col("name").rlike(pattern)).select(F.col("project_id").alias("id"))
    return projects.filter(F.col("status").isin(*statuses)).join(have, "id", "left_anti").join(placeholders.select("id"), "id", "left_anti")


class Strategy(NamedTuple):
    """Candidates (key, target) of one way to match; ``unique`` accepts a key only if it has exactly one target."""

    candidates: DataFrame
    method: str
    confidence: float
    unique: bool = False


def precedence_join(keys: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """(key, target, method, confidence) for every key: the first strategy that has a hit (smallest target), else unresolved."""
    union = None
    for rank, s in enumerate(strategies):
        hits = s.candidates.filter("target is not null").groupBy("key").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n"))
        hits = hits.filter("n = 1") if s.unique else hits
        hits = hits.select("key", F.struct(F.lit(rank).alias("rank"), "target", F.lit(s.method).alias("method"), F.lit(float(s.confidence)).alias("confidence")).alias("hit"))
        union = hits if union is None else union.unionByName(hits)
    best = union.groupBy("key").agg(F.min("hit").alias("hit"))
    out = keys.select("key").distinct().join(best, "key", "left")
    return out.select("key", F.col("hit.target").alias("target"), F.coalesce("hit.method", F.lit("unresolved")).alias("method"), F.coalesce("hit.confidence", F.lit(0.0)).alias("confidence"))


def _runs(df: DataFrame, text: str, sizes: Sequence[int]) -> DataFrame:
    """Rows with ``phrase``: every distinct run of so many tokens of a normalised text."""
    tokens = F.split(text, " ")
    starts = lambda n: F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    runs = lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    of_size = [runs(n) for n in sizes]
    return df.filter(F.col(text) != "").withColumn("phrase", F.explode(F.array_distinct(F.concat(*of_size))))


def _sizes(df: DataFrame, text: str) -> list[int]:
    """The numbers of tokens that occur: one short row each reaches the driver."""
    return sorted(r["n"] for r in df.filter(F.col(text) != "").select(F.size(F.split(text, " ")).alias("n")).distinct().collect())


def phrase_targets(keys: DataFrame, text: str, names: DataFrame, name: str, *, either_way: bool = True) -> DataFrame:
    """(key, target) where a key's normalised text holds a name as a whole-token phrase, or the other way round.

    Runs of tokens meet whole phrases by equality. Of each phrase only the smallest
    target goes on, so a phrase that all names share costs one row per key.
    """
    held = names.filter(F.col(name) != "").groupBy(F.col(name).alias("phrase")).agg(F.min("target").alias("target"))
    name_sizes = _sizes(names, name)
    out = (_runs(keys, text, name_sizes).join(held, "phrase") if name_sizes else keys.join(held, F.lit(False))).select("key", "target")
    text_sizes = _sizes(keys, text) if either_way else []
    if text_sizes:
        inside = _runs(names, name, text_sizes).groupBy("phrase").agg(F.min("target").alias("target"))
        out = out.unionByName(keys.withColumn("phrase", F.col(text)).join(inside, "phrase").select("key", "target"))
    return out


def _prefixes(text: Column) -> Column:
    """All prefixes of three characters or more."""
    return F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(3), F.length(text)), lambda n: F.substring(text, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def _ends(df: DataFrame, by: str) -> DataFrame:
    """Smallest and greatest target per value: they differ if it has several, which is all that a unique match asks."""
    return df.groupBy(by).agg(F.array(F.min("target"), F.max("target")).alias("targets"))


def job_to_project(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Free-text job names (column ``key``) to projects (id, name, code), in tiers of falling confidence."""
    keys = jobs.select("key").distinct()
    norm = keys.withColumn("job", normalize_job(F.col("key"))).filter("job <> ''")
    dim = projects.select(F.col("id").alias("target"), normalize_job(F.col("name")).alias("pname"), normalize_job(F.col("code")).alias("pcode"), street_signature(F.col("name")).alias("street"))
    exact = norm.join(dim, F.col("job") == F.col("pname")).select("key", "target").unionByName(norm.join(dim, F.col("job") == F.col("pcode")).select("key", "target"))
    by_name = phrase_targets(norm, "job", dim, "pname")
    by_code = phrase_targets(norm, "job", dim, "pcode")
    prefix = keys.select("key", F.explode(prefix_candidates(F.col("key"))).alias("c"))
    # A signature starts with a candidate, or a candidate with a signature: one's prefixes meet the other whole.
    signed = dim.filter("length(street) >= 3").select("target", "street")
    starts = _ends(signed.select("target", F.explode(_prefixes(F.col("street"))).alias("c")), "c")
    whole = _ends(signed.select("target", F.col("street").alias("c")), "c")
    met = prefix.join(starts, "c").unionByName(prefix.select("key", F.explode(_prefixes(F.col("c"))).alias("c")).join(whole, "c"))
    street = met.select("key", F.explode("targets").alias("target")).distinct()
    return precedence_join(keys, [Strategy(exact, "job_name", 1.0), Strategy(by_name, "job_phrase", 0.8), Strategy(by_code, "job_code", 0.85), Strategy(street, "street_prefix", 0.7, True)])


def resolve_project_ref(refs: DataFrame, projects: DataFrame) -> DataFrame:
    """References (``key``) to projects: id, code, legacy job number, alias, then a name that holds the reference; smallest id of each tier.

    ``projects`` may have ``legacy_number`` (text) and ``aliases`` (array of texts). Case
    and blanks around a reference do not count.
    """
    trimmed = lambda df: df.select("key").filter("trim(key) <> ''").distinct().withColumn("ref", F.lower(F.trim("key")))
    keys = trimmed(refs)

    def equal(c: Column, dim: DataFrame) -> DataFrame:
        return keys.join(shuffled(dim.groupBy(F.lower(c).alias("ref")).agg(F.min("id").alias("target"))), "ref").select("key", "target")

    tiers = [Strategy(equal(F.col("id").cast("string"), projects), "id", 1.0), Strategy(equal(F.col("code"), projects), "code", 1.0)]
    if "legacy_number" in projects.columns:
        tiers.append(Strategy(equal(F.col("legacy_number"), projects), "legacy_number", 0.95))
    if "aliases" in projects.columns:
        tiers.append(Strategy(equal(F.trim("alias"), projects.select("id", F.explode("aliases").alias("alias"))), "alias", 0.9))
    # Only what no other tier resolves is looked for in names.
    first = Scratch(refs.sparkSession).keep(precedence_join(refs.select("key").distinct(), tiers), "first")
    rest = first.filter("target is null").select("key")
    dim = projects.select(F.col("id").alias("target"), F.lower("name").alias("pname"))
    named = Strategy(contained_targets(trimmed(rest), "ref", dim, "pname", name_in_text=False), "name", 0.8)
    return first.filter("target is not null").unionByName(precedence_join(rest, [named]))


def civic_match(names: DataFrame, projects: DataFrame) -> DataFrame:
    """Names (``key``) to projects by a civic number only one project shares, else by equal normalised names, if unique.

    A name meets two projects at most by each number and by its text, so names and projects
    that share a number are never paired with one another.
    """
    keys = names.select("key").distinct()
    own = keys.select("key", F.explode(civic_numbers(F.col("key"))).alias("civic"))
    dim = projects.select(F.col("id").alias("target"), F.explode(civic_numbers(F.col("name"))).alias("civic"))
    # There are 111,000 numbers of 3 to 5 digits at most.
    shared = F.broadcast(_ends(dim, "civic"))
    named = shuffled(_ends(projects.select(F.col("id").alias("target"), normalize_name(F.col("name")).alias("n")), "n"))
    by_civic = own.join(shared, "civic").select("key", F.explode("targets").alias("target"))
    by_name = keys.withColumn("n", normalize_name(F.col("key"))).filter("n <> ''").join(named, "n").select("key", F.explode("targets").alias("target"))
    return precedence_join(keys, [Strategy(by_civic, "civic", 1.0, True), Strategy(by_name, "name", 1.0, True)])


def exact_match(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(key, target): case-insensitive equality on all fields, accepted only if one row of ``right`` has it."""
    clean = lambda df: df.withColumns({f"_{f}": F.lower(F.trim(f)) for f in fields})
    hits = clean(left).join(clean(right).select(F.col("id").alias("target"), *[f"_{f}" for f in fields]), [f"_{f}" for f in fields])
    return hits.groupBy("key").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy_match(left: DataFrame, right: DataFrame, fields: Sequence[str], *, threshold: float = 0.85, ratio: bool = False) -> DataFrame:
    """(key, target, score): best least similarity over the fields, at ``threshold`` or more; ties to the smallest target.

    Similarity is 1 - edit distance / longer length, or with ``ratio`` the share of
    matching blocks. Case and blanks around a text do not count; a null field matches
    nothing. Every pair that reaches the threshold in the first field is found
    (``near_texts``); equal rows of a side stand for one another, so copies cost nothing.
    """
    clean = lambda df: df.withColumns({f"_{f}": F.lower(F.trim(f)) for f in fields})
    names = [f"_{f}" for f in fields]
    whole = " and ".join(f"{n} is not null" for n in names)
    asked, stored = clean(left).filter(whole), clean(right).filter(whole)
    a = asked.select(*names).distinct().select(F.col(names[0]).alias("a"), F.struct(*names).alias("x"))
    b = stored.groupBy(*names).agg(F.min("id").alias("target")).select(F.col(names[0]).alias("b"), F.struct(*names).alias("y"), "target")
    near = near_texts(a.select(F.col("a").alias("text")), b.select(F.col("b").alias("text")), threshold=threshold, ratio=ratio)
    like = matching_ratio if ratio else similarity
    scores = [like(F.col(f"x.{n}"), F.col(f"y.{n}")) for n in names]
    scored = near.join(a, "a").join(b, "b").withColumn("score", F.least(*scores) if len(scores) > 1 else scores[0])
    best = scored.filter(F.col("score") >= threshold).groupBy("x").agg(F.max(F.struct("score", (-F.col("target")).alias("t"))).alias("m")).select("x.*", "m")
    return asked.join(best, names).select("key", (-F.col("m.t")).alias("target"), F.col("m.score").alias("score"))


def polymorphic_join(proposals: DataFrame, tasks: DataFrame) -> DataFrame:
    """The project of each proposal: its own target, or its task's."""
    of_task = proposals.join(tasks.select(F.col("id").alias("entity_id"), F.col("project_id").alias("task_project")), "entity_id", "left")
    return of_task.select("id", "entity_type", "entity_id", F.when(F.col("entity_type") == "project", F.col("entity_id")).otherwise(F.col("task_project")).alias("project_id"))


def _matched_days(days: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Daily counts (block, day, online, n), sorted by block and day, to runs of pairs: the next n rows of a day with the next n online rows of another."""
    held: list[tuple[int, bool, int]] = []
    block = None

    def runs() -> list[tuple]:
        waiting = deque([day, n, 0] for day, online, n in held if online)
        out = []
        for day, online, need in held:
            used = 0
            while not online and need and waiting and waiting[0][0] <= day + window:
                if waiting[0][0] < day - window:
                    waiting.popleft()  # too old for this day and all that follow
                    continue
                take = min(need, waiting[0][1])
                out.append((block, day, used, waiting[0][0], waiting[0][2], take))
                used, need = used + take, need - take
                waiting[0][1] -= take
                waiting[0][2] += take
                if not waiting[0][1]:
                    waiting.popleft()
        return out

    names = ["block", "day", "rank", "online_day", "online_rank", "n"]
    for frame in days:
        out = []
        for own, day, online, n in zip(frame["block"], frame["day"], frame["online"], frame["n"]):
            if own != block:
                out += runs()
                block, held = own, []
            held.append((day, online, n))
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(runs(), columns=names)


def duplicate_twins(receipts: DataFrame, *, day_window: int = 2) -> DataFrame:
    """(primary, duplicate, total, days): in-store and online rows of one event, one to one.

    Same absolute total, refund sign and project (null equals null), dates within the
    window. In order of (date, id) each in-store row takes the first online row that is
    left. What a row takes depends on the days alone: rows of a day are taken in order,
    and an online day that is too old stays so. So a block of equal amounts is matched by
    its counts per day (as many rows as it has days), as two queues that are merged, and
    the rows find their partners by rank within their day. No block of receipts is ever
    in one task.
    """
    block = F.to_json(F.struct(F.abs("total").alias("amount"), "is_refund", "project_id"))
    rows = receipts.filter("duplicate_of is null and total is not null and sales_date is not null").select(
        block.alias("block"), F.abs("total").alias("total"), F.unix_date("sales_date").alias("day"), F.col("online").cast("boolean").alias("online"), "id"
    )
    # Only blocks with both kinds go on.
    both = rows.groupBy("block").agg(F.max("online").alias("hi"), F.min("online").alias("lo")).filter("hi and not lo").select("block")
    ranked = distributed_rank(rows.join(both, "block", "left_semi"), [F.asc("id")], by=("block", "day", "online"))
    counts = ranked.groupBy("block", "day", "online").agg(F.count(F.lit(1)).alias("n"))
    runs = counts.repartition("block").sortWithinPartitions("block", "day").mapInPandas(lambda days: _matched_days(days, day_window), "block string, day int, rank long, online_day int, online_rank long, n long")
    stores = ranked.filter("not online").select("block", "day", F.col("rank").alias("place"), F.col("id").alias("primary"), "total").join(runs, ["block", "day"])
    stores = stores.filter((F.col("place") >= F.col("rank")) & (F.col("place") < F.col("rank") + F.col("n")))
    stores = stores.select("block", "primary", "total", "day", "online_day", (F.col("online_rank") + F.col("place") - F.col("rank")).alias("online_rank"))
    onlines = ranked.filter("online").select("block", F.col("day").alias("online_day"), F.col("rank").alias("online_rank"), F.col("id").alias("duplicate"))
    return stores.join(onlines, ["block", "online_day", "online_rank"]).select("primary", "duplicate", "total", F.abs(F.col("day") - F.col("online_day")).cast("long").alias("days"))


def duplicate_totals(totals: DataFrame, *, share: float = 0.005, least: float = 1.0) -> DataFrame:
    """Pairs of documents (a before b by id) of one project whose totals differ by at most max(least, share of |a|).

    Totals meet in bands: logarithmic ones for large totals, of one unit for small
    ones, each row in its band and both neighbours' on one side.
    """
    amount = F.abs("total").cast("double")
    # A band is as wide as the tolerance at its top, so two totals within it are at most one band apart.
    band = F.when(amount < least / share, F.floor(amount / least)).otherwise(int(1 / share) + F.floor(F.log(amount / (least / share)) / F.log(F.lit(1 + share))))
    rows = totals.withColumn("band", band.cast("long"))
    left = rows.select("project_id", F.col("document_id").alias("a"), F.col("total").alias("ta"), F.col("is_rollup").alias("ra"), F.explode(F.array(*[F.col("band") + k for k in (-2, -1, 0, 1, 2)])).alias("band"))
    right = rows.select("project_id", F.col("document_id").alias("b"), F.col("total").alias("tb"), F.col("is_rollup").alias("rb"), "band")
    pairs = left.join(right, ["project_id", "band"]).filter("a < b").filter(F.abs(F.col("ta") - F.col("tb")) <= F.greatest(F.lit(least).cast("decimal(18,4)"), F.abs("ta") * F.lit(share).cast("decimal(6,4)")))
    return pairs.select("project_id", "a", "b", F.abs(F.col("ta") - F.col("tb")).cast("decimal(18,2)").alias("gap"), F.when(F.col("ra") | F.col("rb"), "high").otherwise("medium").alias("severity"))


def sender_attribution(messages: DataFrame, projects: DataFrame, defaults: DataFrame, votes: DataFrame, *, vote_key: str = "sender") -> DataFrame:
    """Messages (id, sender, text) to projects: name in the text, a word of it of four letters or more, the sender's default, the recency vote (by ``vote_key``: sender, or message id)."""
    keys = messages.select(F.col("id").alias("key"))
    norm = messages.select(F.col("id").alias("key"), "sender", F.lower("text").alias("words"))
    dim = projects.select(F.col("id").alias("target"), F.lower(F.trim("name")).alias("pname"))
    name = contained_targets(norm.select("key", "words"), "words", dim, "pname", text_in_name=False)
    parts = F.transform(F.split("pname", r"[\s\-/]+"), lambda t: F.regexp_replace(t, r"^[.,:()]+|[.,:()]+$", ""))
    words = dim.select("target", F.explode(F.filter(F.array_distinct(parts), lambda t: F.length(t) >= 4)).alias("w")).groupBy("w").agg(F.min("target").alias("target"))
    met = contained(words, "w", norm, "words").filter(F.expr(r"rlike(hay, concat('\\b\\Q', needle, '\\E\\b'))"))
    of_text = met.join(words.withColumnRenamed("w", "needle"), "needle").groupBy(F.col("hay").alias("words")).agg(F.min("target").alias("target"))
    word = norm.join(of_text, "words").select("key", "target")
    default = norm.join(defaults.select("sender", F.col("project_id").alias("target")), "sender").select("key", "target")
    voted = F.col("key") if vote_key == "id" else F.col(vote_key)
    vote = norm.join(votes.select(F.col(vote_key).alias("_by"), F.col("project_id").alias("target")), voted == F.col("_by")).select("key", "target")
    return precedence_join(keys, [Strategy(name, "text_match", 0.9), Strategy(word, "text_match_word", 0.75), Strategy(default, "worker_default", 0.6), Strategy(vote, "sender_recency", 0.5)])


def task_parent_join(tasks: DataFrame) -> DataFrame:
    """Subtasks with their parent's title, status and start."""
    parent = tasks.select(F.col("id").alias("parent_id"), "project_id", F.col("title").alias("parent_title"), F.col("status").alias("parent_status"), F.col("start_date").alias("parent_start"))
    return tasks.join(parent, ["project_id", "parent_id"], "left")


def dependency_edges(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """(project_id, predecessor_id, successor_id) from linked ids; for a successor with none that resolve, from titles that are unique in the project."""
    known = tasks.select("project_id", F.col("id").alias("predecessor_id"))
    by_id = links.select("project_id", "successor_id", F.explode("linked_ids").alias("predecessor_id")).join(known, ["project_id", "predecessor_id"], "left_semi")
    unique = tasks.groupBy("project_id", "title").agg(F.min("id").alias("predecessor_id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    rest = links.join(by_id.select("project_id", "successor_id").distinct(), ["project_id", "successor_id"], "left_anti")
    by_title = rest.select("project_id", "successor_id", F.explode("linked_titles").alias("title")).join(unique, ["project_id", "title"]).drop("title")
    return by_id.unionByName(by_title).filter("predecessor_id <> successor_id").select("project_id", "predecessor_id", "successor_id").distinct()


def fk_orphans(relations: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, n): child keys without a parent row."""
    out = None
    for name, (child, key, parent, parent_key) in relations.items():
        keys = child.select(F.col(key).alias("k")).filter("k is not null")
        count = keys.join(parent.select(F.col(parent_key).alias("k")).distinct(), "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        out = count if out is None else out.unionByName(count)
    return out


def mislinked_documents(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents whose project's name is no segment of their folder path."""
    joined = documents.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    return joined.filter(~F.array_contains(F.transform(F.split("folder_path", "/"), lambda x: F.trim(x)), F.col("project_name")))


def worker_resolution(names: DataFrame, workers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Raw names (``key``) to workers: equal normalised name, then alias; the rest become unverified stubs of a derived id."""
    keys = names.select("key").distinct()
    norm = keys.withColumn("n", normalize_name(F.col("key"))).filter("n <> ''")
    exact = norm.join(workers.select(F.col("id").cast("string").alias("target"), normalize_name(F.col("name")).alias("n")), "n").select("key", "target")
    alias = norm.join(aliases.select(F.col("worker_id").cast("string").alias("target"), normalize_name(F.col("alias")).alias("n")), "n").select("key", "target")
    found = precedence_join(keys, [Strategy(exact, "exact", 1.0, True), Strategy(alias, "alias", 0.9, True)])
    stub = F.concat(F.lit("stub:"), F.sha2(normalize_name(F.col("key")), 256))
    new = (F.col("method") == "unresolved") & (normalize_name(F.col("key")) != "")
    return found.select("key", F.when(new, stub).otherwise(F.col("target")).alias("target"), F.when(new, "stub").otherwise(F.col("method")).alias("method"), F.when(new, 0.6).otherwise(F.col("confidence")).alias("confidence"))


def site_resolution(sites: DataFrame, projects: DataFrame, hints: DataFrame) -> DataFrame:
    """Site names (``key``) to projects whose name holds them or the other way round, whatever the case, else by hint (key, project_id)."""
    keys = sites.select("key").distinct()
    norm = keys.withColumn("s", F.lower(F.trim("key")))
    dim = projects.select(F.col("id").alias("target"), F.lower("name").alias("pname"))
    hit = contained_targets(norm, "s", dim, "pname")
    hint = keys.join(hints.select("key", F.col("project_id").alias("target")), "key")
    return precedence_join(keys, [Strategy(hit, "site_name", 0.9), Strategy(hint, "hint", 0.5)])


def mail_routing(mails: DataFrame, projects: DataFrame, defaults: DataFrame, *, fallback: int | None = None, system: str = r"(?i)^(no-?reply|mailer-daemon|postmaster)@") -> DataFrame:
    """Mails (id, sender, recipient) to projects by plus-tag (a code, or a part of a name), the sender's default, the global default; system senders are quarantined, other unknown ones marked."""
    tag = F.lower(F.regexp_extract("recipient", r"\+([^@]+)@", 1))
    own = mails.withColumn("tag", tag)
    keys = own.select(F.col("tag").alias("key")).filter("key <> ''").distinct()
    code = keys.join(projects.select(F.col("id").alias("target"), F.lower("code").alias("key")), "key")
    inside = contained_targets(keys.withColumn("t", F.col("key")), "t", projects.select(F.col("id").alias("target"), F.lower("name").alias("pname")), "pname", name_in_text=False)
    by_tag = precedence_join(keys, [Strategy(code, "code", 1.0), Strategy(inside, "name", 0.8)])
    tagged = own.join(by_tag.select(F.col("key").alias("tag"), F.col("target").alias("by_tag")), "tag", "left")
    joined = tagged.join(defaults.select("sender", F.col("project_id").alias("by_sender")), "sender", "left")
    blocked = F.coalesce(F.col("sender").rlike(system), F.lit(False))
    target = F.coalesce("by_tag", "by_sender", F.lit(fallback).cast("bigint"))
    method = F.when(blocked, "quarantined").when(F.col("by_tag").isNotNull(), "plus_tag").when(F.col("by_sender").isNotNull(), "sender_default").when(F.lit(fallback).isNotNull(), "global_default").otherwise("unresolved")
    return joined.select("id", F.when(~blocked, target).alias("project_id"), method.alias("method"), (F.col("by_sender").isNull() & ~blocked).alias("new_sender"))


def scope_context_bind(documents: DataFrame, projects: DataFrame, contexts: DataFrame) -> DataFrame:
    """The folder below the project's own as a registered context of that project: RESOLVED or UNRESOLVED; null without such a folder."""
    joined = documents.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    parts = F.split("folder_path", "/")
    place = F.array_position(parts, F.col("project_name"))
    below = joined.withColumn("segment", F.when(place > 0, F.try_element_at(parts, (place + 1).cast("int"))))
    bound = below.join(contexts.select("project_id", F.col("name").alias("segment"), F.col("id").alias("context_id")), ["project_id", "segment"], "left")
    state = F.when(F.col("segment").isNull(), None).when(F.col("context_id").isNotNull(), "RESOLVED").otherwise("UNRESOLVED")
    return bound.select("id", "project_id", "segment", "context_id", state.alias("state"))


def quote_scope_coverage(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Quote lines with the scope item of their (project, item code); a code that resolves to none is reported, never guessed."""
    joined = lines.join(items.select("project_id", "item_code", F.col("id").alias("item_id")), ["project_id", "item_code"], "left")
    return joined.withColumn("unresolved", F.col("item_code").isNotNull() & F.col("item_id").isNull())


def filename_resolver(files: DataFrame, projects: DataFrame, vendors: DataFrame, packages: DataFrame) -> DataFrame:
    """Parts of ``<code>[-seq]_<TYPE>_<division>-<trade>_<vendor>_<status>.<ext>`` and the project, package and vendor they name.

    The package is that of the division in the project (id, project_id, division_code),
    if it is the only one; ``package_method`` tells none from several. The vendor is an
    exact match of the squeezed name, else the only vendor that contains it.
    """
    pattern = r"^(\d{7})(?:-(\d{3}))?_([A-Za-z]+)(?:_(\d{2})-([A-Za-z]+)_([A-Za-z0-9]+))?(?:_([A-Za-z0-9]+))?\.[A-Za-z0-9]+$"
    part = lambda k: F.nullif(F.regexp_extract("name", pattern, k), F.lit(""))
    parsed = files.select("id", "name", part(1).alias("code"), part(2).alias("sequence"), F.upper(part(3)).alias("doc_type"), part(4).alias("division"), part(5).alias("trade"), part(6).alias("vendor_slug"), part(7).alias("status"))
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    dim = vendors.select(F.col("id").alias("target"), squeeze(F.col("name")).alias("slug"))
    keys = parsed.filter("vendor_slug is not null").select(F.col("vendor_slug").alias("key")).distinct()
    exact = keys.join(dim, squeeze(F.col("key")) == F.col("slug")).select("key", "target")
    squeezed = keys.withColumn("_k", squeeze(F.col("key")))
    inside = contained_targets(squeezed, "_k", dim, "slug", name_in_text=False)
    vendor = precedence_join(keys, [Strategy(exact, "exact", 1.0, True), Strategy(inside, "contains", 0.8, True)])
    out = parsed.join(projects.select(F.col("id").alias("project_id"), "code"), "code", "left")
    held = packages.groupBy("project_id", F.col("division_code").alias("division")).agg(F.min("id").alias("_package"), F.count(F.lit(1)).alias("_packages"))
    out = out.join(held, ["project_id", "division"], "left")
    asked = F.col("project_id").isNotNull() & F.col("division").isNotNull()
    method = F.when(F.col("_packages") == 1, "filename_division_code").when(F.col("_packages") > 1, "ambiguous").when(asked, "none").otherwise("unresolved")
    out = out.withColumns({"package_id": F.when(F.col("_packages") == 1, F.col("_package")), "package_method": method}).drop("_package", "_packages")
    return out.join(vendor.select(F.col("key").alias("vendor_slug"), F.col("target").alias("vendor_id"), F.col("method").alias("vendor_method")), "vendor_slug", "left")

