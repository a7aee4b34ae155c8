"""Chunks, embeddings, search and grounding of amounts in text."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import amount_in_text, document_numbers, keyword_tokens
from ..scratch import Scratch
from .windows import distributed_rank

#: Queries broadcast at a time at most; beyond, the chunks are read once for each block of so many.
MOST_QUERIES = 2000
#: Chunks that are scored against all queries of a block at once.
CHUNKS_AT_ONCE = 2048
#: Damping of ranks in a fused score.
DAMPING = 60
#: Parts in which a query's local leaders are brought together first.
PARTS = 32


def _tokens(size: int) -> int:
    """Estimated tokens of so many characters."""
    return max(1, size // 4) if size else 0


def _fill(ends: np.ndarray, begin: int, room: int) -> int:
    """The place after the last of the items that fit into ``room`` from ``begin`` on, one at least; ``ends`` are cumulative sizes from 0."""
    return max(begin + 1, int(np.searchsorted(ends, ends[begin] + room, "right")) - 1)


#: Fixed value: where a paragraph that is too long may be cut.
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def _units(paragraph: str, target: int) -> list[str]:
    """A paragraph as it is, or, where it is over the target, its sentences and lines in runs that fit; a sentence that does not fit alone is cut by length."""
    if _tokens(len(paragraph)) <= target:
        return [paragraph]
    sentences = [s for s in map(str.strip, _SENTENCE.split(paragraph)) if s]
    # A run of sentences, one space between, has as many characters as its ends are apart, less one.
    ends = np.cumsum([0, *(len(s) + 1 for s in sentences)])
    units, at = [], 0
    while at < len(sentences):
        to = _fill(ends, at, 4 * (target + 1))
        run = " ".join(sentences[at:to])
        width = len(run) if _tokens(len(run)) <= target else max(200, 4 * target)
        units += [run[i : i + width] for i in range(0, len(run), width)]
        at = to
    return units


def chunk_text(text: str | None, target: int = 500, overlap: int = 50) -> list[str]:
    """Whole paragraphs packed up to about ``target`` tokens (characters / 4); a chunk begins with the tail of the one before."""
    paragraphs = map(str.strip, (text or "").replace("\r\n", "\n").split("\n\n"))
    units = [u for p in paragraphs if p for u in _units(p, target)]
    ends = np.cumsum([0, *(_tokens(len(u)) for u in units)])
    chunks: list[str] = []
    at = 0
    while at < len(units):
        tail = chunks[-1][max(0, len(chunks[-1]) - 4 * overlap) :].lstrip() if chunks else ""
        to = _fill(ends, at, target - _tokens(len(tail)))
        chunks.append("\n\n".join(([tail] if tail else []) + units[at:to]))
        at = to
    return chunks


def chunk_documents(texts: DataFrame, *, target: int = 500, overlap: int = 50) -> DataFrame:
    """(document_id, chunk_index, text, token_count, content_hash) of every text; one pass, no shuffle."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, c, _tokens(len(c))) for d, t in zip(frame["document_id"], frame["text"]) for i, c in enumerate(chunk_text(t, target, overlap))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "text", "token_count"])

    key = texts.schema["document_id"].dataType.simpleString()
    return texts.select("document_id", "text").mapInPandas(cut, f"document_id {key}, chunk_index int, text string, token_count int").withColumn("content_hash", F.sha2("text", 256))


def incremental_chunks(chunks: DataFrame, stored: DataFrame, *, model: str = "hash", dims: int = 64) -> DataFrame:
    """Chunks of documents whose list of chunk hashes is new or differs from what is stored (document_id, hashes)."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "key"))), lambda x: x["key"])
    keyed = chunks.withColumn("key", F.sha2(F.concat_ws("|", "text", F.lit(model), F.lit(str(dims))), 256))
    now = keyed.groupBy("document_id").agg(order.alias("hashes"))
    changed = now.join(stored.select("document_id", F.col("hashes").alias("before")), "document_id", "left").filter(F.col("before").isNull() | (F.col("before") != F.col("hashes")))
    return keyed.drop("key").join(changed.select("document_id"), "document_id", "left_semi")


def hash_embed(texts: DataFrame, *, dims: int = 64) -> DataFrame:
    """(document_id, embedding): counts of words by md5 bucket, scaled to length one. ``dims`` is a power of two up to 2**32: the bucket is in the hash's last digits."""
    words = texts.select("document_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    bucket = F.conv(F.substring(F.md5("w"), -8, 8), 16, 10).cast("long") % dims
    counts = words.groupBy("document_id", bucket.cast("int").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    packed = counts.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    return packed.select("document_id", vector.alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


class _Asked:
    """A block of queries as matrices: unit vectors, and the queries that hold each keyword."""

    def __init__(self, ids: list, vectors: list, tokens: list):
        self.ids = ids
        self.dims = max((len(v) for v in vectors if v is not None), default=0)
        self.vectors = np.zeros((len(ids), self.dims))
        for k, v in enumerate(vectors):
            if v is not None and len(v) == self.dims and None not in v:
                self.vectors[k] = v
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.terms: dict[str, list[int]] = {}
        for k, own in enumerate(tokens):
            for t in own or []:
                self.terms.setdefault(t, []).append(k)
        self.sizes = np.array([len(t or []) for t in tokens], dtype=np.float64)

    def scores(self, vectors: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and shares of keywords, rounded to six places, one row per query and one column per chunk."""
        n = len(vectors)
        rows = np.zeros((n, self.dims))
        whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), self.dims), False).to_numpy(zero_copy_only=False)
        if whole.any() and self.dims:
            flat = pc.list_flatten(vectors.filter(pa.array(whole))).cast(pa.float64()).to_numpy(zero_copy_only=False)
            rows[whole] = flat.reshape(-1, self.dims)
            rows[np.isnan(rows).any(axis=1)] = 0.0
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        scale = np.outer(self.norms, norms)
        cosine = np.divide(self.vectors @ rows.T, scale, out=np.zeros((len(self.ids), n)), where=scale > 0)
        held = np.zeros((len(self.ids), n))
        postings: dict[str, list[int]] = {}
        for at, own in enumerate(tokens.to_pylist()):
            for t in own or []:
                if t in self.terms:
                    postings.setdefault(t, []).append(at)
        for t, chunks in postings.items():
            held[np.ix_(self.terms[t], chunks)] += 1
        share = np.divide(held, self.sizes[:, None], out=np.zeros_like(held), where=self.sizes[:, None] > 0)
        return np.round(cosine, 6) + 0.0, np.round(share, 6)


def _scored(asked: _Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids in ascending order, cosines and keyword shares of blocks of chunks (id, embedding, tokens)."""
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNKS_AT_ONCE):
            batch = whole.slice(at, CHUNKS_AT_ONCE)
            batch = batch.take(pc.sort_indices(batch.column(0)))
            yield batch.column(0).to_numpy(zero_copy_only=False), *asked.scores(batch.column(1), batch.column(2))


def _ahead(values: np.ndarray, ids: np.ndarray, own: np.ndarray, own_ids: np.ndarray) -> np.ndarray:
    """How many of (values, ids), in ascending order of ids, come before each of (own, own_ids): greater, or as great with a smaller id."""
    order = np.argsort(values, kind="stable")
    ascending, named = values[order], ids[order]
    low, high = np.searchsorted(ascending, own, "left"), np.searchsorted(ascending, own, "right")
    out = len(values) - high
    for v in np.unique(own[high > low]):
        same = np.flatnonzero(own == v)
        out[same] += np.searchsorted(named[low[same[0]] : high[same[0]]], own_ids[same])
    return out


def hybrid_search(queries: DataFrame, chunks: DataFrame, *, top_k: int = 12, min_similarity: float = 0.0) -> DataFrame:
    """Per query the chunks of best fused rank 1 / (60 + cosine rank) + 1 / (60 + keyword rank), ranks counted from 0.

    ``queries``: query_id, embedding, query_text; ``chunks``: id (a whole number),
    embedding, text. Ties go to the smaller id. A threshold bounds what can win: the
    best ``top_k`` by either rank score 1 / (59 + top_k) at least, and a chunk behind
    place 60 + 2 top_k in both lists scores less. So only the chunks before that place
    in a list are candidates. One pass over the chunks finds them: a task scores its
    chunks in blocks, as a matrix product and an inverted index of the queries'
    keywords, and sends on its leaders alone. A second pass counts, for each
    candidate, the chunks that rank ahead of it, so ranks are exact. Rows written per
    query: 2 (60 + 2 top_k) a task. Chunks that share a score, however many, cost no more.
    A vector that is null, of another length or holds a null has cosine 0.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark)
    numbered = scratch.keep(queries.select("query_id", "embedding", keyword_tokens(F.col("query_text")).alias("tokens")), "queries")
    blocks = max(1, -(-numbered.count() // MOST_QUERIES))
    prepared = chunks.select(F.col("id").cast("long").alias("id"), "embedding", keyword_tokens(F.col("text")).alias("tokens"))
    # Twice as many blocks as needed, so that none of them, dealt by hash, grows beyond the bound.
    block = F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))
    parts = [numbered.filter(block == b) for b in range(2 * blocks)] if blocks > 1 else [numbered]
    return functools.reduce(DataFrame.unionByName, [_search_block(p.toArrow(), prepared, scratch, f"{b}", top_k, min_similarity, queries.schema["query_id"].dataType.simpleString()) for b, p in enumerate(parts)])


def _search_block(block: pa.Table, chunks: DataFrame, scratch: Scratch, name: str, top_k: int, min_similarity: float, kind: str) -> DataFrame:
    context, depth = chunks.sparkSession.sparkContext, DAMPING + 2 * top_k
    asked = context.broadcast(_Asked(*(block.column(c).to_pylist() for c in ("query_id", "embedding", "tokens"))))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, ...] | None] = [None, None]
        for ids, *scores in _scored(asked.value, batches):
            for side in (0, 1):
                own = (np.broadcast_to(ids, scores[0].shape), scores[side], scores[1 - side])
                if best[side] is not None:
                    own = tuple(np.concatenate([a, b], axis=1) for a, b in zip(best[side], own))
                    by_id = np.argsort(own[0], axis=1, kind="stable")
                    own = tuple(np.take_along_axis(a, by_id, axis=1) for a in own)
                first = np.argsort(-own[1], axis=1, kind="stable")[:, :depth]
                best[side] = tuple(np.take_along_axis(a, first, axis=1) for a in own)
        for side in (0, 1):
            if best[side] is not None:
                ids, mine, other = best[side]
                query = np.repeat(np.arange(len(ids)), ids.shape[1])
                columns = [query, ids.ravel(), (mine, other)[side].ravel(), (other, mine)[side].ravel(), np.full(len(query), side)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "id", "similarity", "keyword", "side"])

    leaders = chunks.mapInArrow(lead, "q long, id long, similarity double, keyword double, side long")
    order = [F.desc(F.when(F.col("side") == 0, F.col("similarity")).otherwise(F.col("keyword"))), F.asc("id")]
    for by in (["q", "side", F.pmod(F.xxhash64("id"), F.lit(PARTS))], ["q", "side"]):
        leaders = leaders.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= depth)
    candidates = scratch.keep(leaders.select("q", "id", "similarity", "keyword").distinct(), f"candidates-{name}")
    # At most two times ``depth`` rows a query.
    table = candidates.toArrow().sort_by([("q", "ascending"), ("id", "ascending")])
    held = context.broadcast(tuple(table.column(c).to_numpy() for c in ("q", "id", "similarity", "keyword")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own_ids, similarity, keyword = held.value
        at = np.searchsorted(q, np.arange(len(asked.value.ids) + 1))
        ahead = np.zeros((2, len(q)), dtype=np.int64)
        for ids, cosine, share in _scored(asked.value, batches):
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                ahead[0, a:b] += _ahead(cosine[k], ids, similarity[a:b], own_ids[a:b])
                ahead[1, a:b] += _ahead(share[k], ids, keyword[a:b], own_ids[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own_ids), pa.array(ahead[0]), pa.array(ahead[1])], names=["q", "id", "sem", "kw"])

    ranks = chunks.mapInArrow(count, "q long, id long, sem long, kw long").groupBy("q", "id").agg(F.sum("sem").alias("sem"), F.sum("kw").alias("kw"))
    fused = candidates.join(ranks, ["q", "id"]).withColumn("score", F.round(1 / (DAMPING + F.col("sem")) + 1 / (DAMPING + F.col("kw")), 9))
    fused = fused.filter((F.col("similarity") >= min_similarity) | (F.col("keyword") > 0))
    best = fused.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= top_k)
    named = chunks.sparkSession.createDataFrame(pa.table({"q": pa.array(range(block.num_rows), pa.int64()), "query_id": block.column("query_id")}))
    # What both sides hold has the bound of a block of queries.
    found = best.join(F.broadcast(named), "q").select(F.col("query_id").cast(kind).alias("query_id"), "id", "similarity", "keyword", "score", "rank")
    found = scratch.keep(found, f"found-{name}")
    asked.destroy()
    held.destroy()
    return found


def amount_grounding(amounts: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (document_id, amount) with ``found``: whether the amount stands in its document's text."""
    numbers = texts.select("document_id", document_numbers(F.col("text")).alias("numbers"))
    return amounts.join(numbers, "document_id", "left").withColumn("found", amount_in_text(F.col("amount"), F.coalesce("numbers", F.array().cast("array<decimal(24,2)>")))).drop("numbers")


def audit_summary(grounded: DataFrame, texts: DataFrame) -> DataFrame:
    """Per document: rows, how many amounts are flagged verified, how many stand in the text, whether a text is missing."""
    have = texts.filter("text is not null").select("document_id", F.lit(True).alias("has_text"))
    out = grounded.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("verified"), 1)).alias("verified"), F.count(F.when(F.col("found"), 1)).alias("found"))
    return out.join(have, "document_id", "left").withColumn("missing_text", F.col("has_text").isNull()).drop("has_text")


def render_markdown_table(text: Column) -> Column:
    """Tab-separated lines as a markdown table; rows are padded to the widest."""
    rows = F.transform(F.split(text, "\n"), lambda line: F.split(line, "\t"))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), width), ""))
    return F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0)))), "\n")


__all__ = ["amount_grounding", "audit_summary", "chunk_documents", "cosine", "distributed_rank", "hash_embed", "hybrid_search", "incremental_chunks", "render_markdown_table"]
