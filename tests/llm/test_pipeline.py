import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from tallyforge.llm import ngram_join, toxicity

from .test_ngram_join import brute
from .test_other_operators import toxic_corpus


def tables(spark, folder):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in toxic_corpus(240)]
    rows += [(1000 + i, t, "en", "s0", n) for i, t, _, _, n in rows[:40]]
    rows += [(2000 + i, f"Site menu and footer\n{t}", "fr", "s1", n) for i, t, _, _, n in rows[60:100]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_corpus(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_do_what_they_say(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    want = {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == want
        elif name == "line_dedup":
            assert ids == want
            texts = [r.text for r in docs.collect()]
            assert not any("Site menu and footer" in t for t in texts)
        elif name == "ngram_jaccard_join":
            parts = brute([(r.doc_id, r.text) for r in before.collect()])
            assert ids == {i for i, c in parts.items() if i == c}
        else:
            assert ids <= {r.doc_id for r in before.collect()}
    assert all(r.round_trip for r in docs.collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r.doc_id for r in docs.collect())


def test_stages_take_odd_and_empty_rows(spark, odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 14) if not any(re.match(rf"op{n}_", x) for x in names)] == []
    assert "pipeline" in names
    assert ngram_join.MOST_BROADCAST > 0
