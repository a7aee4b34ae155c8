"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two documents link when their sets of five-word shingles have a Jaccard
similarity of 0.75 or more. Linked sets of sizes m and n share at least 3/4 of
either set, so under one global order of shingles, rare ones first, the first k
shared shingles lie within the first n - ceil(3n/4) + k of each set (its prefix).

* Light sets (up to a boundary) list all 2-subsets of their prefix for k = 2: two
  linked light sets have a subset in common.
* Heavy sets scan the inverted lists of their prefix for k = 1. Light sets large
  enough to link with a heavy one stand in these lists too.
* The boundary is the size that makes the cost of listing subsets plus scanning
  lists least, by sums over all sets of what either would cost.

The order comes from a count sketch over all shingles (a fixed 2**22 counters):
an order only has to be the same everywhere, so a full sketch costs speed and
never a link.

Equal sets form one class, and only its smallest id goes on. Components are found
in two steps, both with exact verification. First each set is checked against
its neighbours in its lists; this joins most near copies. Then the lists whose
members are in different components give all pairs across components (every list
but for pairs inside its largest component). A pair inside one component can
change nothing. So a group of thousands of near copies is never paired with
itself, and no link between components is lost.

Defined results: a text of one to four words has its whole sequence as its only
shingle; texts without words, or null, have an empty set and link with nothing;
rows that share an id count as one node with the links of each row; a row with a
null id gets the component of an equal set, else null; very long texts are read
whole; an empty table gives an empty one; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import numbered
from .components import connected_components, crossing, with_components
from ..scratch import Scratch
from .words import blocks, distinct_sorted, mix, shingles, words

SKETCH_BITS = 22
CHUNK_BITS = 14
#: Ids (one number each) broadcast at most; beyond, the tables are joined by shuffles.
MOST_BROADCAST = 1_000_000
#: Members of one list that one task takes at most; a longer list is dealt out by salt.
LIST_SHARE = 4096
#: Bits of a set's parity signature: bit i tells whether an odd number of its shingles fall on i.
PARITY_BITS = 1024
#: Boundaries weighed against one another.
BOUNDARIES = (0, 4, 8, 12, 16, 20, 24, 32, 40, 48, 64)


def required(m, n):
    """Least overlap of sets of m and n elements with Jaccard 0.75: ceil(3 (m + n) / 7)."""
    return F.ceil((m + n) * 3 / 7)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_classes(texts: DataFrame) -> np.ndarray:
    """One byte per sketch slot: 8 log2(1 + count) of the shingles in it, over all texts.

    Each task sends its counters in compressed chunks, which are summed as they
    arrive; 4 MB of classes come back, whatever the input.
    """
    size = 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for block in blocks(batch, "text"):
                np.add.at(total, _slot(shingles(words(block.column(0)))[0]), 1)
        if total.any():
            chunks = total.reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in chunks], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(pa.decompress(counts, decompressed_size=4 * size, codec="zstd", asbytes=True), dtype=np.uint32)
                sums[chunk] = sums[chunk] + own if chunk in sums else own.astype(np.uint64)
        if sums:
            levels = [np.minimum(255, 8 * np.log2(1.0 + c)).astype(np.uint8).tobytes() for c in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "level"])

    out = np.zeros((1 << SKETCH_BITS >> CHUNK_BITS, size), dtype=np.uint8)
    summed = texts.mapInArrow(count, "chunk int, counts binary").repartition(32, "chunk").mapInArrow(add, "chunk int, level binary").toArrow()
    for chunk, level in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist()):
        out[chunk] = np.frombuffer(level, dtype=np.uint8)
    return out.reshape(-1)


def _estimate(levels: np.ndarray, noise: float) -> np.ndarray:
    """Documents a shingle is thought to be in: its slot's count less the mean of all slots."""
    return np.maximum(1.0, 2.0 ** (levels / 8.0) - 1.0 - noise)


def shingle_sets(docs: DataFrame, levels, noise: float) -> DataFrame:
    """Per row of (id, text): n, two 64-bit sums that tell sets apart, the prefix for k = 2 (in order), the cost of scanning its lists and the parity bits of the set."""
    table = levels

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = table.value
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = distinct_sorted(*shingles(words(block.column(1))))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets)
                at = np.append(0, np.cumsum(n))
                total = np.zeros((2, len(flat) + 1), dtype=np.uint64)
                np.cumsum(mix(flat), out=total[0, 1:])
                np.cumsum(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
                sums = (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)
                rank = level[_slot(flat)]
                order = rank.astype(np.uint64) << np.uint64(56) | flat >> np.uint64(8)
                prefixes, costs = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    first = np.argsort(order[a:b], kind="stable")[: (b - a) // 4 + 2]
                    prefixes.append(flat[a:b][first])
                    costs.append(float(_estimate(rank[a:b][first[: (b - a) // 4 + 1]], noise).sum()))
                ends = np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32)
                slots = np.repeat(np.arange(len(n)), n) * PARITY_BITS + (flat & np.uint64(PARITY_BITS - 1)).astype(np.int64)
                odd = np.bincount(slots, minlength=len(n) * PARITY_BITS) & 1
                parity = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                starts = np.arange(0, len(parity) + 1, PARITY_BITS // 64, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).view(np.int64))), pa.array(costs, pa.float64()), pa.ListArray.from_arrays(pa.array(starts), pa.array(parity))],
                    names=["id", "n", "s1", "s2", "prefix", "scan", "parity"],
                )

    return docs.mapInArrow(build, f"id {docs.schema['id'].dataType.simpleString()}, n long, s1 long, s2 long, prefix array<long>, scan double, parity array<long>")


def choose_boundary(sets: DataFrame) -> int:
    """The largest light size: least total of subsets listed and lists scanned. One row per size up to the largest boundary reaches the driver."""
    top = max(BOUNDARIES)
    k = F.least(F.col("n"), F.floor(F.col("n") / 4) + 2)
    rows = sets.groupBy(F.least(F.col("n"), F.lit(top + 1)).alias("n")).agg(F.sum(k * (k - 1) / 2).alias("subsets"), F.sum("scan").alias("scan"), F.count(F.lit(1)).alias("rows")).collect()
    cost = {b: sum(r["subsets"] for r in rows if r["n"] <= b) + sum(r["scan"] for r in rows if 4 * r["n"] > 3 * b) for b in BOUNDARIES}
    return min(BOUNDARIES, key=lambda b: (cost[b], b))


def postings(sets: DataFrame, boundary: int, levels, noise: float) -> DataFrame:
    """(key, salt, id, n, s1, pos): 2-subsets of light sets, prefix shingles of those that may meet a heavy one (pos: place in the order, else -1)."""
    id_type = sets.schema["id"].dataType.simpleString()
    table = levels

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = table.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                n = batch.column(1).to_numpy()
                prefix = batch.column(2)
                values = np.asarray(prefix.flatten()).view(np.uint64)
                at = np.asarray(prefix.offsets).astype(np.int64)
                at = at - at[0]
                keys, rows, places, seen = [], [], [], []
                heavy = np.flatnonzero(4 * n > 3 * boundary)
                size = np.minimum(n[heavy] // 4 + 1, n[heavy])
                row = np.repeat(heavy, size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                token = values[at[row] + place]
                keys.append(token)
                rows.append(row)
                places.append(place)
                seen.append(_estimate(level[_slot(token)], noise))
                for i in np.flatnonzero((n <= boundary) & (n >= 2)).tolist():
                    own = values[at[i] : at[i + 1]]
                    x, y = np.triu_indices(len(own), 1)
                    keys.append(mix(own[x] * np.uint64(0xD6E8FEB86659FD93) + own[y]))
                    rows.append(np.full(len(x), i))
                    places.append(np.full(len(x), -1))
                    seen.append(_estimate(level[_slot(own[x])], noise))
                row = np.concatenate(rows)
                shares = np.ceil(np.concatenate(seen) / LIST_SHARE).astype(np.uint64)
                key = np.concatenate(keys)
                salt = (mix(row.astype(np.uint64) + np.uint64(begin) + mix(n[row].astype(np.uint64))) % np.maximum(shares, np.uint64(1))).astype(np.int32)
                salt = np.where(shares > 1, salt + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(salt), batch.column(0).take(pa.array(row)), pa.array(n[row].astype(np.int32)), batch.column(3).take(pa.array(row)), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["key", "salt", "id", "n", "s1", "pos"],
                )

    return sets.select("id", "n", "prefix", "s1").mapInArrow(emit, f"key long, salt int, id {id_type}, n int, s1 long, pos int")


def _may_link(a: str, b: str):
    """Size filter, and what must hold at the first shingle in the order that a linked pair shares: all that it shares stands from there on."""
    na, nb, pa_, pb = (F.col(f"{x}.{y}") for x, y in ((a, "n"), (b, "n"), (a, "pos"), (b, "pos")))
    least = required(na, nb)
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & ((pa_ < 0) | (pb < 0) | ((na - pa_ >= least) & (nb - pb >= least)))


def _parity_allows(a: str, b: str):
    """No linked pair fails this: bits that differ are at most as many as the shingles only one set has, of which a linked pair has a seventh of m + n at most."""
    differ = sum((F.bit_count(F.get(F.col(f"{a}.parity"), i).bitwiseXOR(F.get(F.col(f"{b}.parity"), i))) for i in range(1, PARITY_BITS // 64)), F.bit_count(F.get(F.col(f"{a}.parity"), 0).bitwiseXOR(F.get(F.col(f"{b}.parity"), 0))))
    return differ * 7 <= F.col(f"{a}.n") + F.col(f"{b}.n")


def verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets of their documents, hashed anew from the text."""
    pairs = scratch.keep(pairs, f"{name}-pairs")
    needed = scratch.keep(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-needed")
    few = needed.count() <= MOST_BROADCAST

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = distinct_sorted(*shingles(words(block.column(1))))
                at = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "hashes"])

    wanted = docs.join(F.broadcast(needed) if few else needed, "id", "left_semi").select("id", "text")
    sets = scratch.keep(wanted.mapInArrow(build, f"id {docs.schema['id'].dataType.simpleString()}, hashes array<long>"), f"{name}-sets")
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    links = scratch.keep(two.filter(shared * 100 >= (F.size("ha") + F.size("hb") - shared) * 75).select("a", "b").distinct(), f"{name}-links")
    scratch.drop(f"{name}-pairs", f"{name}-needed", f"{name}-sets")
    return links


def near_candidates(lists: DataFrame, most: int = 3) -> DataFrame:
    """Step one: each set with up to ``most`` of those that lead its lists or stand before it, most frequent first. Which ones are tried decides the speed only; step two tries every pair that is left."""
    near = lists.filter("prev is not null").select(F.explode(F.array("first", "prev")).alias("p"), F.struct("id", "n", "pos").alias("q"))
    near = near.filter("p.id <> q.id").filter(_may_link("p", "q"))
    counted = near.groupBy(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    best = Window.partitionBy("b").orderBy(F.desc("times"), "a")
    return counted.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most).select("a", "b")


def telling_lists(lists: DataFrame) -> DataFrame:
    """Of lists with the same members only the one whose shingle comes first in the order.

    The shingles of a shared passage all have the same list. The first shingle that a
    pair shares is the first of its kind, so no pair loses the list that shows it.
    A member is a set of an id (an id may have several) and stands once in a list.
    Lists are told apart by their length and two sums of hashes of their members,
    which cannot cancel; a sum of 32-bit halves cannot overflow.
    """
    mark = F.xxhash64("id", "s1")
    marks = lists.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum(F.shiftright(mark, 32)).alias("x0"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("x1"), F.sum("pos").alias("place"))
    first = marks.groupBy("members", "x0", "x1").agg(F.min(F.struct("place", "key")).alias("m")).select(F.col("m.key").alias("key"))
    return lists.join(first, "key", "left_semi")


def cross_candidates(lists: DataFrame, known: DataFrame, parities: DataFrame, scratch: Scratch) -> DataFrame:
    """Step two: every pair of one list that lies in different components and may link.

    Most lists lie in one component by now and go first, by the least and the greatest
    component of each. Members are paired without their parity bits, which are joined
    to the distinct pairs alone.
    """
    owned = scratch.keep(with_components(lists.select("key", "id", "n", "s1", "pos"), known), "owned")
    ends = owned.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    members = scratch.keep(owned.join(ends, "key", "left_semi"), "open")
    told = telling_lists(members).withColumnRenamed("s1", "mark")
    met = crossing(told, known, scratch).filter(_may_link("p", "q"))
    swap = F.col("p.id") > F.col("q.id")
    side = lambda first, second: F.when(swap, F.struct(f"{second}.id", f"{second}.n", f"{second}.mark")).otherwise(F.struct(f"{first}.id", f"{first}.n", f"{first}.mark"))
    pairs = scratch.keep(met.select(side("p", "q").alias("x"), side("q", "p").alias("y")).distinct(), "met")
    scratch.drop("owned", "open")
    bits = lambda name: parities.select(F.struct("id", "n", F.col("s1").alias("mark")).alias(name), F.col("parity").alias(f"{name}_parity"))
    both = pairs.join(bits("x"), "x").join(bits("y"), "y")
    both = both.select(*[F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.n").alias("n"), F.col(f"{c}_parity").alias("parity")).alias(c) for c in ("x", "y")])
    return both.filter(_parity_allows("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links, its own included) and class_id (the smallest id with an equal set)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    levels = frequency_classes(picked.select("text"))
    noise = float(np.mean(2.0 ** (levels / 8.0) - 1.0))
    table = spark.sparkContext.broadcast(levels)
    sets = scratch.keep(shingle_sets(picked, table, noise), "sets")

    keys = ["n", "s1", "s2"]
    classes = sets.filter("n > 0").groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    several = scratch.keep(classes.filter("rows > 1").drop("rows"), "classes")
    held = F.broadcast(several) if several.count() <= MOST_BROADCAST else several
    # One row stands for a class: the copies of its set go, not the other sets of their ids.
    named = sets.filter("id is not null")
    lead = scratch.keep(named.join(held, keys).filter("id = rep").drop("rep").select(*sets.columns).dropDuplicates(["id", *keys]), "lead")
    single = named.filter("n > 0").join(held, keys, "left_anti").select(*sets.columns).unionByName(lead)
    # An id with several sets is one node: it ties the classes that its sets are copies in.
    span = [f(c).alias(f"{c}{k}") for c in keys for k, f in enumerate((F.min, F.max))]
    several_sets = scratch.keep(named.groupBy("id").agg(*span).filter(" or ".join(f"{c}0 <> {c}1" for c in keys)).select("id"), "several-sets")
    held_by = named.select("id", *keys).join(several_sets, "id").join(held, keys).filter("id <> rep")
    ties = scratch.keep(held_by.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "ties")

    # Lists tell members apart by id and s1; where an id has one set, s1 tells nothing and 0 stands for it.
    flags = several_sets.withColumn("several", F.lit(True))
    flags = F.broadcast(flags) if several_sets.count() <= MOST_BROADCAST else flags
    single = single.join(flags, "id", "left").withColumn("s1", F.when(F.col("several"), F.col("s1")).otherwise(F.lit(0).cast("long"))).drop("several")

    boundary = choose_boundary(single)
    emitted = postings(single, boundary, table, noise)
    # A set that others are copies of has few rare shingles of its own: its shared ones stand early, so it leads its lists.
    order = Window.partitionBy("key", "salt").orderBy("pos", "n", "id")
    member = F.struct("id", "n", "pos")
    first = F.first(member).over(order.rowsBetween(Window.unboundedPreceding, 0))
    shared = emitted.withColumns({"prev": F.lag(member).over(order), "first": first, "next": F.lead("n").over(order)})
    lists = scratch.keep(shared.filter("prev is not null or next is not null or salt > 0").drop("next"), "lists")

    links = verified(near_candidates(lists), picked, scratch, "near").unionByName(ties)
    known = connected_components(links, scratch, "cc1")
    more = verified(cross_candidates(lists, known, single.select("id", F.col("n").cast("int").alias("n"), "s1", "parity"), scratch), picked, scratch, "cross")
    final = connected_components(links.unionByName(more), scratch, "cc2")
    scratch.drop("lists", "lead", "ties", "several-sets", "near-links", "cross-links")

    small = final.count() <= MOST_BROADCAST
    final = final.select(F.col("node").alias("rep"), "component")
    rows = sets.select("id", *keys).join(held, keys, "left").withColumn("rep", F.coalesce("rep", "id"))
    rows = rows.join(F.broadcast(final) if small else final, "rep", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("rep")).alias("class_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, per id that names its component: of an id's rows the one with the least text; rows with a null id stay."""
    found = link_components(docs, id_col=id_col, text_col=text_col)
    gone = found.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    scratch = Scratch(docs.sparkSession)
    gone = scratch.keep(gone, "gone")
    small = gone.count() <= MOST_BROADCAST
    work, (key, text) = numbered(docs, id_col, text_col)
    kept = work.join(F.broadcast(gone) if small else gone, F.col(key) == F.col("_gone"), "left_anti")
    again = scratch.keep(docs.groupBy(docs[id_col].alias("_again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and _again is not null").drop("n"), "again")
    again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again
    repeated = F.col(key) == F.col("_again")
    row = F.min_by(F.struct(*work.columns), F.struct(F.col(text).isNull(), F.col(text))).alias("row")
    one = kept.join(again, repeated, "left_semi").groupBy(key).agg(row).select("row.*")
    return kept.join(again, repeated, "left_anti").unionByName(one).toDF(*docs.columns)
