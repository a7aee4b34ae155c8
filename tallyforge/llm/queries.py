"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edit_fingerprint, license_scan, line_dedup, mixing, ngram_join, packing, phrases, prefix_trie, quality_rules, sentencepiece_nbest, toxicity, url_filter, warc
from ..scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), scratch.path("archives"))
    index = scratch.keep(warc.index_archives(spark, scratch.path("archives")), "index")
    return warc.read_records(index, with_payload=False).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), details=True)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The label of a page is that of the document with its number: quality 0 is a bad outcome.
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return url_filter.url_filter(table(spark, sf_dir, "pages"), outcomes)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "source", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = Scratch(spark).keep(edit_fingerprint.edit_fingerprints(table(spark, sf_dir, "documents")), "prints")
    found = edit_fingerprint.near_copies(prints).dropDuplicates(["doc_id"])
    return prints.join(found, "doc_id", "left")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.nbest_encode(table(spark, sf_dir, "documents"), with_ids=False)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_collocations(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(lists, head, base))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_warc, op3_license_scan, op4_mixing, op5_url_filter,
        op6_line_dedup, op7_quality_rules, op8_edit_fingerprint, op9_toxicity, op10_sentencepiece_nbest,
        op11_phrase_mining, op12_packing, op13_prefix_trie,
    )
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
with recursive w as (select doc_id, {_WORDS} as ws from documents where text is not null),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' ')) when len(ws) > 0 then [list_aggregate(ws, 'string_agg', ' ')] else [] end) as s from w)),
n as (select doc_id, count(*) as n from sh group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
reach(node, goal) as (select doc_id, doc_id from n union select node, b from reach join links on goal = a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(r.c, d.doc_id) as component_id, coalesce(k.c, d.doc_id) as class_id
from documents d left join n using (doc_id) left join (select node, min(goal) as c from reach group by 1) r on r.node = d.doc_id
left join (select doc_id, min(doc_id) over (partition by all_s) as c from (select doc_id, list_sort(list(s)) as all_s from sh group by 1)) k on k.doc_id = d.doc_id""",
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, ''))::bigint as b from pages),
g as (select h, max(page_id) as first from p where b >= 1000 group by h)
select page_id, b as payload_bytes, sha1(p.h) as payload_digest, case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to
from p left join g on p.h = g.h and p.b >= 1000""",
    "op4_mixing": mixing.mix_sql(),
    "op5_url_filter": url_filter.url_filter_sql(),
    "op11_phrase_mining": phrases.phrase_collocations_sql(),
    "op13_prefix_trie": prefix_trie.prefix_trie_sql(),
    "op6_line_dedup": r"""
with l as (select doc_id, source, string_split(text, chr(10)) as ls from documents),
t as (select source, count(*) as pages from documents group by 1),
c as (select source, line, count(*) as n from (select source, unnest(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as line from l) group by 1, 2),
d as (select c.source, list(line) as gone from c join t on c.source is not distinct from t.source where n >= 3 and n * 100 > pages * 10 group by 1),
k as (select l.doc_id, l.source, ls, case when gone is null then ls else list_filter(ls, lambda x: not list_contains(gone, x)) end as kept from l left join d on l.source is not distinct from d.source)
select doc_id, source, coalesce(len(ls), 0)::bigint as n_lines, (coalesce(len(ls), 0) - coalesce(len(kept), 0))::bigint as n_dropped, case when ls is not null then md5(coalesce(array_to_string(kept, chr(10)), '')) end as text_md5 from k""",
}
