"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at step j it emits the current character and
moves on by r(j, character), a random bit. Texts at a small edit distance then
emit sequences at a small Hamming distance. One walk over a whole text loses step
at the first long insertion and may not find it again, so a text is read by WALKS
walks with random starts that texts share: walk w begins at the run of GRAM
characters of least hash among those whose hash falls to w. The run stands where
it stood whatever was inserted before it, so an edit disturbs the walks near it and
no others, in texts of any length. What a walk emits at sampled steps is folded
into two bytes; likeness is the share of equal bytes.

Near copies are found by bit-sampled bands: each band takes the bytes of eight
walks as a key, which texts that share a passage of half their length have in common
once in hundreds of bands. Sharing a key proposes a pair, likeness verifies it.

Defined results: null counts as the empty text; equal texts have equal
fingerprints and likeness 1, two empty ones included; repeated ids are ordered by
the SHA-256 of their texts and count as one node of the links; rows with a null id
get fingerprints and the component of an equal one, else null; very long texts are
read whole; an empty table gives an empty one; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType

from ..scratch import Scratch
from .components import contracted_components, crossing, dealt, merged, reaching
from .words import mix

WALKS = 64
GRAM = 8
#: Steps at which a walk's characters are folded into its first and its second byte.
SAMPLED = ((16, 21, 26), (31, 36, 41))
#: Bands, and walks in each.
BANDS, BAND_WALKS = 32, 8
#: Likeness from which two fingerprints are near copies.
LEAST = 0.75
#: Classes before it in a key that a class may be tried against at first, and tries over all keys.
BEFORE, TRIED = 3, 6
#: Rows of small tables broadcast at most.
MOST_BROADCAST = 1_000_000
#: Code points read at once: bounds a worker's memory.
CHUNK_CHARS = 1 << 20
_SEED = 20240601
_WIDTH = 2 * WALKS
_GAP = np.zeros(GRAM, dtype=np.uint8).tobytes()

_tables: list[np.ndarray] = []


def walk_bits() -> np.ndarray:
    """The shared random bits by (step, walk, character); no walk moves on from the 0 after a text."""
    if not _tables:
        bits = np.random.Generator(np.random.PCG64(_SEED)).integers(0, 2, size=(SAMPLED[1][-1] + 1, WALKS, 256), dtype=np.uint8)
        bits[:, :, 0] = 0
        _tables.append(bits)
    return _tables[0]


def band_walks() -> np.ndarray:
    """The walks of each band; every walk is in as many."""
    rng = np.random.Generator(np.random.PCG64([_SEED, BANDS]))
    return np.concatenate([rng.permutation(WALKS).reshape(-1, BAND_WALKS) for _ in range(BANDS * BAND_WALKS // WALKS)])


def characters(text: str) -> np.ndarray:
    """One byte from 1 to 255 for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return ((points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of 2 * WALKS bytes for each text; that of an empty text is all zeros."""
    out = np.zeros((len(texts), _WIDTH), dtype=np.uint8)
    begin = 0
    while begin < len(texts):
        end, chars = begin, 0
        while end < len(texts) and (end == begin or chars + len(texts[end]) <= CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        out[begin:end] = _fingerprints(texts[begin:end])
        begin = end
    return out


def _starts(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each walk of each text begins, -1 in an empty one; a walk that no run falls to begins where the next one does that has a run."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    runs = np.ndarray((len(data) - GRAM + 1,), dtype="<u8", buffer=data, strides=(1,))[place]
    hashes = mix(runs)
    slot = owner * WALKS + (hashes >> np.uint64(58)).astype(np.int64)
    least = np.full(n * WALKS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, slot, hashes)
    first = np.flatnonzero(hashes == least[slot])[::-1]
    start = np.full(n * WALKS, -1, dtype=np.int64)
    start[slot[first]] = place[first]
    start = start.reshape(n, WALKS)
    twice = np.concatenate([start, start], axis=1)
    there = np.where(twice >= 0, np.arange(2 * WALKS), 2 * WALKS)
    following = np.minimum.accumulate(there[:, ::-1], axis=1)[:, ::-1][:, :WALKS]
    return np.where(following < 2 * WALKS, np.take_along_axis(twice, np.minimum(following, 2 * WALKS - 1), axis=1), -1)


def _fingerprints(texts: list[str]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # A gap of zeros after each text: no run of characters and no walk passes into the next.
    data = np.frombuffer(_GAP.join([characters(t).tobytes() for t in texts]) + _GAP, dtype=np.uint8)
    begin = np.cumsum(sizes + GRAM) - (sizes + GRAM)
    at = _starts(data, begin, sizes)
    some = at >= 0
    at = np.where(some, at, len(data) - 1)
    column = np.arange(WALKS) * 256
    out = np.zeros((len(texts), WALKS, 2), dtype=np.uint8)
    folded = np.zeros(at.shape, dtype=np.uint32)
    for j, bits in enumerate(walk_bits().reshape(-1, WALKS * 256)):
        c = data.take(at)
        for k, steps in enumerate(SAMPLED):
            if j in steps:
                folded = (folded ^ c) * np.uint32(0x01000193)
                if j == steps[-1]:
                    out[:, :, k] = np.where(some, (folded ^ folded >> np.uint32(15)) % np.uint32(255) + np.uint32(1), 0)
                    folded = np.zeros(at.shape, dtype=np.uint32)
        at = at + bits.take(c + column)
    return out.reshape(len(texts), _WIDTH)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes of fingerprints, row by row."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FINAL = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


class _Row:
    """A text with its fingerprint; texts travel compressed."""

    def __init__(self, key, size: int, packed: bytes, print_: bytes):
        self.key, self.packed, self.size, self.print = key, packed, size, print_

    @property
    def text(self) -> str:
        return pa.decompress(self.packed, decompressed_size=self.size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if self.size else ""


def _compared(rows: list[tuple[_Row, _Row]]) -> list[tuple]:
    """Result rows of texts and those that follow them."""
    own = [a.text for a, _ in rows]
    changed = [edited(t, b.text) for t, (_, b) in zip(own, rows)]
    other = fingerprints(changed)
    mine, following = (np.frombuffer(b"".join(r[k].print for r in rows), dtype=np.uint8).reshape(-1, _WIDTH) for k in (0, 1))
    return [
        (a.key, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), a.print.hex(), o.tobytes().hex(), float(x), float(y))
        for (a, _), t, e, o, x, y in zip(rows, own, changed, other, likeness(mine, other), likeness(mine, following))
    ]


def packed_prints(texts: DataFrame) -> DataFrame:
    """(id, digest, size, packed, print) of (id, text): SHA-256, bytes, compressed bytes and fingerprint; a map."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part.column(1).to_pylist()
                raw = [t.encode("utf-8", "surrogatepass") for t in own]
                columns = [
                    pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int64()),
                    pa.array([pa.compress(r, codec="zstd", asbytes=True) if r else b"" for r in raw], pa.binary()), pa.array([f.tobytes() for f in fingerprints(own)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "digest", "size", "packed", "print"])

    return texts.mapInArrow(pack, f"id {texts.schema['id'].dataType.simpleString()}, digest binary, size long, packed binary, print binary")


def edit_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_partition: int = 5000) -> DataFrame:
    """Fingerprint every text and its edited form (its second half replaced by the start of the next text by id).

    Texts are fingerprinted where they are read. One range shuffle by id, of
    compressed texts, puts neighbours side by side; each partition streams through
    its sorted rows. Only a partition's last row needs the first row of the next
    partition: these few rows meet in a join by partition number.
    """
    scratch = Scratch(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    id_type = picked.schema["id"].dataType
    parts = max(1, -(-picked.count() // rows_per_partition))
    head = f"id {id_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    tail = "part int, first_size long, first_packed binary, first_print binary, last_size long, last_packed binary, last_print binary"
    final = pa.schema([("id", to_arrow_type(id_type)), ("n_chars", pa.int64()), *((c, pa.string()) for c in FINAL[1:4]), *((c, pa.float64()) for c in FINAL[4:])])
    ends = pa.schema([("part", pa.int32()), *((f"{end}_{c}", t) for end in ("first", "last") for c, t in (("size", pa.int64()), ("packed", pa.binary()), ("print", pa.binary())))])
    whole = pa.schema([*final, *ends])

    def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        for batch in batches:
            waiting: list[tuple[_Row, _Row]] = []
            size = 0
            for row in map(_Row, *(batch.column(k).to_pylist() for k in range(4))):
                first = first or row
                if last:
                    waiting.append((last, row))
                    size += last.size
                last = row
                if size > CHUNK_CHARS:
                    yield table([(*r, *[None] * len(ends)) for r in _compared(waiting)], whole)
                    waiting, size = [], 0
            if waiting:
                yield table([(*r, *[None] * len(ends)) for r in _compared(waiting)], whole)
        if last:
            yield table([(last.key, *[None] * len(FINAL), part, first.size, first.packed, first.print, last.size, last.packed, last.print)], whole)

    ordered = packed_prints(picked).repartitionByRange(parts, "id").sortWithinPartitions("id", "digest").select("id", "size", "packed", "print")
    found = scratch.keep(ordered.mapInArrow(neighbours, f"{head}, {tail}"), "neighbours")
    edges = found.filter("part is not null")
    # One narrow row per partition: each one's next, and the first after the last.
    numbers = edges.select("part")
    after = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    firsts = edges.select(F.col("part").alias("next_part"), "first_size", "first_packed", "first_print")
    meet = edges.select("part", "id", "last_size", "last_packed", "last_print").join(after, "part").join(firsts, "next_part")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, *rest = (batch.column(k)[i].as_py() for k in range(7))
                yield table(_compared([(_Row(key, *rest[:3]), _Row(None, *rest[3:]))]), final)

    joined = meet.select("id", "last_size", "last_packed", "last_print", "first_size", "first_packed", "first_print").mapInArrow(across, head)
    inner = found.filter("part is null").select("id", *FINAL)
    return inner.unionByName(joined).withColumnRenamed("id", id_col)


def band_keys() -> list:
    """One key per band over the column ``print``."""
    return [F.xxhash64(F.lit(b), *(F.substring("print", 2 * int(w) + 1, 2) for w in own)) for b, own in enumerate(band_walks())]


@F.pandas_udf(ArrayType(LongType()))
def as_longs(prints: pd.Series) -> pd.Series:
    """The bytes of fingerprints, eight to a number."""
    return pd.Series(list(np.frombuffer(b"".join(prints), dtype="<i8").reshape(-1, _WIDTH // 8)))


def alike(a: str, b: str):
    """``likeness`` of two columns of longs: a byte that differs leaves a one at its lowest place."""
    folded = lambda x, shift: F.transform(x, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, shift)))
    x = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    for shift in (4, 2, 1):
        x = folded(x, shift)
    return 1 - F.aggregate(x, F.lit(0), lambda n, v: n + F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))) / _WIDTH


def verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, ha, b, hb) whose classes (id, mark, longs) have a likeness of ``least`` or more."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("mark").alias(f"h{c}"), F.col("longs").alias(f"p{c}"))
    return pairs.join(side("a"), ["a", "ha"]).join(side("b"), ["b", "hb"]).filter(alike("pa", "pb") >= least).select("a", "b").distinct()


def near_copies(prints: DataFrame, *, id_col: str = "doc_id", fingerprint_col: str = "fingerprint", least: float = LEAST) -> DataFrame:
    """Per row: id, class_id (smallest id with an equal fingerprint) and component_id (smallest id reachable by links).

    Equal fingerprints are one class. In each band a class is first verified against
    TRIED of those that lead its keys or stand before it, most frequent first, in an
    order that differs from key to key, which joins most near copies. A class outside
    the largest component of a key is then compared with that component until one link
    is found, and at last all pairs outside it that still lie in different components
    are, in blocks. So a group of near copies is never paired with itself, and no link
    between components that any band shows is lost.
    """
    scratch = Scratch(prints.sparkSession)
    own = prints.select(prints[id_col].alias("id"), F.unhex(prints[fingerprint_col]).alias("print"))
    classes = scratch.keep(own.groupBy("print").agg(F.min("id").alias("id")).withColumns({"mark": F.xxhash64("print"), "longs": as_longs("print")}), "classes")
    named = classes.filter("id is not null")
    members = scratch.keep(dealt(named.select("id", "mark", F.explode(F.array(*band_keys())).alias("key")), scratch), "members")
    order = Window.partitionBy("key", "salt").orderBy(F.xxhash64("mark", "id", "key"), "id", "mark")
    member = F.struct("id", "mark")
    before = [F.first(member).over(order.rowsBetween(Window.unboundedPreceding, 0)), *(F.lag(member, k).over(order) for k in range(1, BEFORE + 1))]
    near = members.select(F.array_distinct(F.array_compact(F.array(*before))).alias("ps"), member.alias("q")).select(F.explode("ps").alias("p"), "q").filter("p.id <> q.id")
    sides = (F.struct("p.id", "p.mark"), F.struct("q.id", "q.mark"))
    times = near.groupBy(F.least(*sides).alias("x"), F.greatest(*sides).alias("y")).agg(F.count(F.lit(1)).alias("times"))
    best = Window.partitionBy("y").orderBy(F.desc("times"), F.xxhash64("x", "y"), "x")
    tried = times.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= TRIED)
    pairs = tried.select(F.col("x.id").alias("a"), F.col("x.mark").alias("ha"), F.col("y.id").alias("b"), F.col("y.mark").alias("hb"))
    one = scratch.keep(verified(pairs, named, least), "one")
    known = contracted_components(one, scratch, "cc1")
    # Verified where they meet: of a class's links to the largest component one leaves the join, of those between two outside it all, as pairs of components.
    details, like = named.select("id", "mark", "longs"), alike("p.longs", "q.longs") >= least
    reached, outside = reaching(members, known, scratch, like, details=details)
    reached, outside = scratch.keep(reached, "reached"), scratch.keep(outside, "outside")
    known = merged(known, reached, scratch, "cc2")
    met = crossing(outside, known, scratch, details=details).filter(like)
    two = scratch.keep(met.select(F.col("p.component").alias("a"), F.col("q.component").alias("b")).distinct(), "two")
    final = merged(known, two, scratch, "cc3")
    small = lambda df: F.broadcast(df) if df.count() <= MOST_BROADCAST else df
    joined = classes.select("print", F.col("id").alias("class_id")).join(small(final), F.col("class_id") == F.col("node"), "left")
    of_class = joined.select("print", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    scratch.drop("members", "one", "reached", "outside", "two")
    return own.join(of_class, "print").select(F.col("id").alias(id_col), "class_id", "component_id")
