import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import edit_fingerprint as E
from tallyforge.llm import license_scan as L
from tallyforge.llm import line_dedup as D
from tallyforge.llm import mixing as M
from tallyforge.llm import quality_rules as Q
from tallyforge.llm import sentencepiece_nbest as S
from tallyforge.llm import toxicity as T
from tallyforge.llm import url_filter as U
from tallyforge.llm import warc as W
from tallyforge.scratch import Scratch

from .conftest import words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# WARC


def pages(spark):
    long = "<p>" + "x" * 2000
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (3, "http://a/\r\n3", "short"), (4, "http://a/4", "short"), (5, "u", None), (6, "u", "é" * 700), (6, "u", "é" * 700), (None, "n", long), (7, "w", "WARC/1.1\r\n\r\nnot a record"), (8, "v", "")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int").repartition(3)


def test_warc_round_trip(spark):
    scratch, df = Scratch(spark), pages(spark)
    W.write_archives(df, scratch.path("a"), records_per_file=2)
    index = scratch.keep(W.index_archives(spark, scratch.path("a")), "index")
    got = W.read_records(index).collect()
    assert len(got) == 11
    want = Counter((str(r.page_id) if r.page_id is not None else None, hashlib.sha1((r.html or "").encode()).hexdigest(), len((r.html or "").encode())) for r in df.collect())
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == want
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {("1", "revisit", "9"), ("2", "revisit", "9"), ("9", "response", None), (None, "revisit", "9"), ("6", "response", None), ("3", "response", None), ("4", "response", None)} <= kinds
    assert all(r.payload == {"3": "short", "5": "", "7": "WARC/1.1\r\n\r\nnot a record"}[r.page_id] for r in got if r.page_id in ("3", "5", "7"))
    some = W.read_records(index.filter("page_id in ('3', '9')")).collect()
    assert sorted(r.page_id for r in some) == ["3", "9"]


def test_warc_of_an_empty_table(spark):
    scratch = Scratch(spark)
    W.write_archives(pages(spark).limit(0), scratch.path("a"))
    assert W.read_records(W.index_archives(spark, scratch.path("a"))).count() == 0


def test_ranges_join_only_within_gap_and_size():
    assert W.coalesce_ranges([(0, 10), (12, 20), (500, 510), (510, 900)], gap=5, most=100) == [(0, 2, 20), (2, 3, 510), (3, 4, 900)]


# Licences


def test_license_scan_matches_brute_force_and_inherits(spark):
    rows = [(1, "Released under the MIT License.", "r/LICENSE"), (2, "code here", "r/src/a.c"), (3, "Intro text.\nLicensed under the Apache License, Version 2.0. More.", "r/src/b.c"), (4, "code", "q/x.c"), (5, None, "r/src/deep/e.c"), (6, "the of under this", "q/y.c"), (7, "x", None), (7, "x", None), (8, "Licensed under CC BY-NC 4.0.", "r/src/deep/COPYING")]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, path string, license double")
    got = {r.doc_id: r for r in L.license_scan(df, path=F.col("path")).collect()}
    assert {i: (r.license, r.origin, r.from_dir) for i, r in got.items()} == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "r"), 3: ("Apache-2.0", "own", None), 4: (None, "none", None), 5: ("CC-BY-NC-4.0", "inherited", "r/src/deep"), 6: (None, "none", None), 7: (None, "none", None), 8: ("CC-BY-NC-4.0", "own", None),
    }


def test_license_cosine_matches_brute_force(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.text]
    n = odd_docs.count()
    vocabulary = {w for t in L.TEMPLATES.values() for w in L.template_words(t)}
    df = Counter(w for _, t in rows for w in set(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) & vocabulary)
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 if w in vocabulary else math.log(n + 1) + 1
    vectors = L._vectors({w: idf(w) for w in vocabulary}, L.TEMPLATES)
    best = {}
    for i, t in rows:
        for unit in re.split(r"(?<=[.!?])[ \t]+|\n", t):
            tf = Counter(re.findall("[a-z0-9]+", unit.lower()))
            norm = math.sqrt(sum((c * idf(w)) ** 2 for w, c in tf.items()))
            for name, v in vectors.items():
                cos = sum(c * idf(w) * v.get(w, 0) for w, c in tf.items()) / norm if norm else 0
                if cos >= L.THRESHOLD:
                    best[i] = max(best.get(i, (0, "")), (round(cos, 6), name))
    got = {r.doc_id: (r.cosine, r.license) for r in L.license_scan(odd_docs).collect() if r.origin == "own"}
    assert got == best


def test_license_scan_of_an_empty_table(no_docs):
    assert L.license_scan(no_docs).count() == 0


# Mixing


def raked(cells, rounds):
    """Plain loops: rake, cut to the tokens, again; targets scaled to 90 % of what every category has."""
    total = sum(c[3] for c in cells)
    weight = {c[:3]: float(c[3]) for c in cells}
    have = {c[:3]: float(c[3]) for c in cells}
    shares, limit = [], 1.0
    for d, name in enumerate(M.DIMENSIONS):
        own = Counter()
        for c in cells:
            own[c[d]] += c[3]
        flat = {k: v ** M.FLATTEN[name] for k, v in own.items()}
        shares.append({k: v / sum(flat.values()) for k, v in flat.items()})
        limit = min(limit, min(own[k] / (total * v) for k, v in shares[d].items()))
    target = [{k: 0.9 * limit * total * v for k, v in s.items()} for s in shares]
    for _ in range(rounds):
        for d in range(3):
            margin = Counter()
            for k, w in weight.items():
                margin[k[d]] += w
            weight = {k: w * target[d][k[d]] / margin[k[d]] if margin[k[d]] else w for k, w in weight.items()}
        weight = {k: min(w, have[k]) for k, w in weight.items()}
    return weight


def test_raking_matches_brute_force(spark):
    rng = random.Random(1)
    cells = [(s, lang, t, rng.randint(1, 900)) for s in ("a", "b", "c") for lang in ("en", "fr") for t in ("p", "q")]
    got = M.calibrated_cells(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")).collect()
    want = raked(cells, M.ROUNDS)
    assert all(r.weight == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-6) for r in got)


@pytest.mark.parametrize("most_cells", [M.MOST_CELLS, 1])
def test_raking_to_given_targets(spark, monkeypatch, most_cells):
    monkeypatch.setattr(M, "MOST_CELLS", most_cells)
    cells = [("a", "en", "p", 90), ("b", "en", "p", 30), ("a", "fr", "p", 30), ("b", "fr", "p", 60)]
    df = M.calibrated_cells(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), targets={"source": {"a": 1, "b": 1}, "lang": {"en": 3, "fr": 1}, "topic": {"p": 1}})
    rows = df.collect()
    drawn = sum(r.weight for r in rows)
    share = lambda d: {r[d]: sum(x.weight for x in rows if x[d] == r[d]) / drawn for r in rows}
    # At 0.9 * 160 tokens, which each category has, b could not fill its half: less is drawn.
    assert 80 < drawn < 144
    assert share("source") == pytest.approx({"a": 0.5, "b": 0.5}, rel=0.02) and share("lang") == pytest.approx({"en": 0.75, "fr": 0.25}, rel=0.02)
    assert all(r.probability <= 1 for r in rows)


@pytest.mark.parametrize("most_cells", [M.MOST_CELLS, 1])
def test_the_sample_meets_the_targets(spark, monkeypatch, most_cells):
    monkeypatch.setattr(M, "MOST_CELLS", most_cells)
    rng = random.Random(12)
    rows = [(i, "w " * 40, "big" if i % 10 else "small", "en" if rng.random() < 0.8 else "fr") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"big": 1, "small": 1}, "lang": {"en": 2, "fr": 1}}
    kept = M.mix(docs, targets=targets).collect()
    assert 850 < len(kept) < 1300
    assert sum(r.source == "big" for r in kept) / len(kept) == pytest.approx(1 / 2, abs=0.04)
    assert sum(r.lang == "en" for r in kept) / len(kept) == pytest.approx(2 / 3, abs=0.04)


@pytest.mark.parametrize("most_cells", [M.MOST_CELLS, 1])
def test_contradicting_marginals_end_in_the_least_error_fit(spark, monkeypatch, most_cells):
    monkeypatch.setattr(M, "MOST_CELLS", most_cells)
    # Each source has one language, so both cannot have the shares they ask for.
    cells = [("s1", "en", "p", 100), ("s2", "fr", "p", 900)]
    df = M.calibrated_cells(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), targets={"source": {"s1": 1, "s2": 1}, "lang": {"en": 3, "fr": 1}, "topic": {"p": 1}})
    rows = {r.source: r for r in df.collect()}
    # The largest total is kept: 0.9 times 100 tokens over a share of 3/4; languages are raked last.
    assert rows["s1"].weight == pytest.approx(90) and rows["s2"].weight == pytest.approx(30)
    error = {(r.dimension, r.category): r.error for r in M.marginals(df).collect()}
    assert error == pytest.approx({("source", "s1"): 0.5, ("source", "s2"): 0.5, ("lang", "en"): 0.0, ("lang", "fr"): 0.0, ("topic", "p"): 0.0}, abs=1e-9)


def test_mixing_sql_lowers_the_total_alike(spark):
    import duckdb

    # A small source has nearly all of a language, so no sample at the first total can hold both.
    rows = [(i, "w " * (40 + i % 7), "big" if i % 10 else "small", "fr" if i % 10 == 0 or i % 97 == 0 else "en") for i in range(3000)] + [(9000, None, None, "en"), (9001, "w w", None, None), (9002, "w", "lone", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(M.mix_sql()).fetchall()
    got = M.mix(docs, details=True).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_mixing_odd_rows(odd_docs, no_docs):
    kept = M.mix(odd_docs)
    assert kept.columns == odd_docs.columns
    details = M.mix(odd_docs, details=True).collect()
    assert len(details) == odd_docs.count() and all(0 <= r.probability <= 1 for r in details)
    texts = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in details) == texts
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in details if r.kept)
    assert M.mix(no_docs).count() == 0 and M.mix(no_docs, details=True).count() == 0


# URLs


def test_url_rules_and_parsing(spark):
    rows = [(1, "http://WWW.Example.com/en/1?x#y"), (2, "https://a.example.com/en/"), (3, "http://x.com"), (4, "http://x.com/"), (5, "http://n.net/es/q"), (6, None), (7, "no scheme"), (8, "a://b://c/d"), (9, "http://evilcom/"), (9, "http://evilcom/")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_filter(df, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("x.com", "", None, "allow"), 4: ("x.com", "/", "com/", "allow"),
        5: ("n.net", "/es/q", "net/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("b:", "//c/d", None, "allow"), 9: ("evilcom", "/", None, "allow"),
    }


def test_bad_hosts_are_blocked_and_priors_flow_down(spark):
    rows, labels, k = [], [], 0
    for host, n, bad in (("bad.spam.org", 60, 58), ("other.spam.org", 60, 50), ("fine.good.org", 60, 1), ("shop.good.org", 60, 2), ("new.spam.org", 1, None), ("new.good.org", 1, None)):
        for i in range(n):
            rows.append((k, f"http://{host}/p"))
            if bad is not None:
                labels.append((k, int(i < bad)))
            k += 1
    got = {r.host: r for r in U.url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels + [(None, 1), (0, None)], "page_id long, bad int")).collect()}
    assert got["bad.spam.org"].verdict == "block" and got["fine.good.org"].verdict == "allow"
    assert got["new.spam.org"].rate > got["new.good.org"].rate
    assert got["new.spam.org"].bound < got["bad.spam.org"].bound


def test_few_outcomes_of_others_block_nobody(spark):
    # A bad suffix of 45 outcomes: its hosts without a bad outcome of their own or their domain stay, a bad one goes.
    rows, labels, k = [], [], 0
    for host, n, bad in [("worst.bad.net", 20, 18), *((f"h{i}.d{i}.net", 3, 0) for i in range(10)), ("none.d99.net", 2, None), *((f"h{i}.ok.com", 40, 3) for i in range(20))]:
        for i in range(n):
            rows.append((k, f"http://{host}/p"))
            if bad is not None:
                labels.append((k, int(i < bad)))
            k += 1
    got = {r.host: r.verdict for r in U.url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"worst.bad.net"}


def test_labels_dealt_at_random_block_about_none(spark):
    rng = random.Random(3)
    rows = [(k, f"http://h{k % 60}.d{k % 20}.{'com' if k % 3 else 'net'}/p") for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for _ in range(2):
        labels = spark.createDataFrame([(k, int(rng.random() < 0.15)) for k, _ in rows], "page_id long, bad int")
        got = U.url_filter(pages, labels, rules=()).filter("verdict = 'block'").select("host").distinct().count()
        assert got <= 1


def test_suffixes_of_ports_users_and_addresses(spark):
    hosts = ["x.com:8080", "u:p@a.b.co.uk", "10.0.0.1", "10.0.0.1:80", "[::1]:80", "plain", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.s, r.d) for r in df.select("host", *[c.alias(n) for c, n in zip(U.suffix_and_domain(F.col("host")), "sd")]).collect()}
    assert got == {"x.com:8080": ("com", "x.com"), "u:p@a.b.co.uk": ("co.uk", "b.co.uk"), "10.0.0.1": ("10.0.0.1",) * 2, "10.0.0.1:80": ("10.0.0.1",) * 2, "[::1]:80": ("[::1]",) * 2, "plain": ("plain",) * 2, "": ("", "")}


@pytest.mark.parametrize("most_broadcast", [U.MOST_BROADCAST, 0])
def test_the_query_blocks_a_host_by_its_outcomes(spark, tmp_path, monkeypatch, most_broadcast):
    from tallyforge.llm.queries import QUERIES

    monkeypatch.setattr(U, "MOST_BROADCAST", most_broadcast)
    rows = [(i, f"http://h{i % 20}.example.org/p") for i in range(2000)] + [(2000 + i, "http://bad.spam.org/p") for i in range(100)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, int(i // 20 % 10 > 0) if i < 2000 else 0, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op5_url_filter"](spark, folder).collect()
    assert len(got) == len(rows) and {r.host for r in got if r.verdict == "block"} == {"bad.spam.org"}
    assert all(r.rule is None for r in got)


# Lines


def test_line_dedup_matches_brute_force(odd_docs, no_docs):
    rows = odd_docs.collect()
    pages_of, seen = Counter(r.source for r in rows), Counter()
    for r in rows:
        for line in {x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)}:
            seen[r.source, line] += 1
    gone = {k for k, n in seen.items() if n >= 3 and 100 * n > 10 * pages_of[k[0]]}
    want = Counter((r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x) not in gone)) for r in rows)
    out = D.line_dedup(odd_docs)
    assert out.columns == odd_docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert gone and D.line_dedup(no_docs, counts=True).count() == 0


# Quality


def brute_quality(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    times, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def plain_encoders():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encode, partial = Q.load_vocabulary("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    return [(model.encode, [model.is_byte(i) for i in range(model.get_piece_size())]), (lambda w: encode([w])[0], partial)]


def plain_measures(text, encode, is_byte):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for w in ws for i in encode(w)]
    if not ids:
        return 0, None, None, None
    share = np.array(list(Counter(ids).values())) / len(ids)
    return len(ids), sum(map(len, ws)) / len(ids), sum(bool(is_byte[i]) for i in ids) / len(ids), float(-(share * np.log2(share)).sum())


def test_quality_counts_and_fertility_match_brute_force(odd_docs, no_docs):
    got = Q.quality_rules(odd_docs).collect()
    by_text = Counter((r.doc_id, brute_quality(r.text)) for r in odd_docs.collect())
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == by_text
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id not in (None, 7)}
    for r in got:
        if r.doc_id in texts:
            for k, (encode, is_byte) in enumerate(plain_encoders()):
                want = plain_measures(texts[r.doc_id], encode, is_byte)
                assert [r[f"n_tokens_{k}"], *(r[f"{m}_{k}"] for m in Q.MEASURES)] == pytest.approx(list(want))
    assert all(not r.kept for r in got if r.base_failed)
    assert Q.quality_rules(no_docs).count() == 0


def test_quality_bands_match_brute_force_and_reject_junk(spark):
    rng = random.Random(21)
    rows = []
    for i in range(150):
        lang = "en" if i < 120 else "xx" if i % 2 else None
        text = words(rng, rng.randint(60, 150))
        if i % 30 == 0:
            text = " ".join("$$$ ### %%%".split()[rng.randrange(3)] + w[:1] for w in text.split())
        rows.append((i, text, lang))
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least_texts=100).collect()}
    found = {i: [plain_measures(t, *e) for e in plain_encoders()] for i, t, _ in rows}
    judged = [i for i, _, _ in rows if not got[i].base_failed and found[i][0][0] >= Q.LEAST_TOKENS]

    def fences(ids, k, m):
        values = sorted(found[i][k][1 + m] for i in ids)
        low, high = (values[math.ceil(p * len(values)) - 1] for p in (0.25, 0.75))
        reach = Q.REACH * max(high - low, Q.LEAST_RANGE * high)
        return low - reach, high + reach

    for i, _, lang in rows:
        ids = [j for j in judged if lang != "en" or j < 120]
        good = not got[i].base_failed
        for k in range(2):
            n, per, share, entropy = found[i][k]
            (low, high), (_, most), (least, _) = (fences(ids, k, m) for m in range(3))
            good = good and (n < Q.LEAST_TOKENS or (low <= per <= high and share <= max(most, Q.FREE_BYTE_SHARE) and entropy >= least))
        assert got[i].kept == good and got[i].band == ("en" if lang == "en" else "Latin")
    assert not any(got[i].kept for i in range(0, 150, 30)) and sum(r.kept for r in got.values()) >= 142


def test_repeats_in_other_capitals_are_no_repeats(spark):
    rng = random.Random(9)
    phrase = " ".join(f"word{rng.randint(0, 99)}" for _ in range(8))
    texts = [f"{phrase} and then {phrase.title()}", f"{phrase} and then {phrase}", f" {phrase.upper()} x {phrase.title()} y {phrase.upper()}", "", " A b", "É un deux trois quatre é un deux trois quatre É un deux trois quatre"]
    got = Q.quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()
    want = {}
    for i, t in enumerate(texts):
        ws = t.split()
        times, hit = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)), set()
        for k in range(len(ws) - 4):
            if times[tuple(ws[k : k + 5])] > 1:
                hit |= set(range(k, k + 5))
        want[i] = len(hit)
    assert {r.doc_id: r.n_repeat_words for r in got} == want
    assert want[0] == 0 and want[1] == 16 and not [r for r in got if r.doc_id == 0][0].base_failed


# Fingerprints


def plain_print(text):
    """One fingerprint by plain loops."""
    codes = [int(c) for c in E.characters(text)]
    at = {}
    for i in range(len(codes)):
        run = sum((codes[i + k] if i + k < len(codes) else 0) << 8 * k for k in range(E.GRAM))
        h = int(E.mix(np.array([run], dtype=np.uint64))[0])
        at[h >> 58] = min(at.get(h >> 58, (h, i)), (h, i))
    out = []
    for w in range(E.WALKS):
        if not at:
            out += [0, 0]
            continue
        i = next(at[(w + k) % E.WALKS][1] for k in range(E.WALKS) if (w + k) % E.WALKS in at)
        emitted = []
        for bits in E.walk_bits():
            c = codes[i] if i < len(codes) else 0
            emitted.append(c)
            i += int(bits[w, c])
        for steps in E.SAMPLED:
            folded = 0
            for j in steps:
                folded = (folded ^ emitted[j]) * 0x01000193 & 0xFFFFFFFF
            out.append((folded ^ folded >> 15) % 255 + 1)
    return bytes(out)


def test_fingerprints_match_a_plain_walk():
    rng = random.Random(2)
    texts = ["", "a", "ab" * 10, words(rng, 300), words(rng, 300) + "é", "", words(rng, 6000), "é😀" * 3000, "abcdefg"]
    assert [f.tobytes() for f in E.fingerprints(texts)] == [plain_print(t) for t in texts]
    assert [f.tobytes() for t in texts for f in E.fingerprints([t])] == [plain_print(t) for t in texts]


def with_edits(rng, text, share):
    out = list(text)
    for _ in range(max(1, int(share * len(out)))):
        i = rng.randrange(len(out))
        out[i] = rng.choice(["", "z", out[i] + "q"])
    return "".join(out)


def test_likeness_falls_with_edits_and_not_with_moves_of_the_rest():
    rng = random.Random(3)
    base = [words(rng, 400) for _ in range(40)]
    own = E.fingerprints(base)
    like = lambda texts: np.sort(E.likeness(own, E.fingerprints(texts)))
    assert (like(base) == 1).all()
    assert like([with_edits(rng, t, 0.002) for t in base])[4] >= 0.75
    assert like([words(rng, 8) + " " + t for t in base])[4] >= 0.75
    assert like([E.edited(t, u) for t, u in zip(base, base[1:] + base[:1])]).max() < 0.6
    assert like(base[1:] + base[:1]).max() < 0.2


@pytest.mark.parametrize("per_partition", [5, 10_000])
def test_edit_fingerprints_match_brute_force(odd_docs, per_partition):
    order = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest())
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=order)
    want = Counter()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        changed = E.edited(t, following)
        f, g, h = E.fingerprints([t, changed, following])
        want[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), f.tobytes().hex(), g.tobytes().hex(), float(E.likeness(f, g)), float(E.likeness(f, h))] += 1
    got = E.edit_fingerprints(odd_docs, rows_per_partition=per_partition).collect()
    assert Counter(tuple(r) for r in got) == want


def test_edit_fingerprints_of_an_empty_table(no_docs):
    prints = E.edit_fingerprints(no_docs)
    assert prints.count() == 0 and E.near_copies(prints).count() == 0


def components(pairs, nodes):
    of = {n: n for n in nodes}
    while True:
        before = dict(of)
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
        if of == before:
            return of


def print_rows(texts):
    return [(i, f.tobytes().hex()) for i, f in enumerate(E.fingerprints(texts))]


@pytest.mark.parametrize("share", [4096, 3])
def test_near_copies_match_brute_force(spark, monkeypatch, share):
    from tallyforge.llm import components as C

    monkeypatch.setattr(C, "KEY_SHARE", share)
    monkeypatch.setattr(C, "SALT_SHARE", share)
    rng = random.Random(4)
    base = [words(rng, 150) for _ in range(40)]
    texts = base + [with_edits(rng, t, 0.004) for t in base] + [with_edits(rng, base[0], 0.006) for _ in range(30)] + [base[1], base[1], "", ""]
    rows = print_rows(texts)
    prints = {i: np.frombuffer(bytes.fromhex(f), dtype=np.uint8) for i, f in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and E.likeness(prints[a], prints[b]) >= E.LEAST]
    got = {r.doc_id: r for r in E.near_copies(spark.createDataFrame([*rows, (None, rows[1][1]), rows[5]], "doc_id long, fingerprint string")).collect()}
    want = components(pairs, prints)
    missed = [i for i in prints if got[i].component_id != want[i]]
    assert len(missed) <= 0.02 * len(rows)
    assert got[None].component_id == got[1].component_id and got[112].class_id == got[113].class_id == 112 and got[110].class_id == 1


def test_links_of_a_near_group_are_not_all_kept(spark, monkeypatch):
    """A group that no first try has joined: links and edges grow with its members, not with their pairs."""
    from tallyforge.scratch import Scratch

    kept, keep = {}, Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    monkeypatch.setattr(E, "TRIED", 0)
    rng = np.random.Generator(np.random.PCG64(8))
    base = rng.integers(1, 256, size=(2, 2 * E.WALKS), dtype=np.uint8)
    # Two groups, unlike one another; a member differs from its group in four bytes of the same two walks.
    group = np.repeat(base, 150, axis=0)
    group[:, :4] = rng.integers(1, 256, size=(300, 4))
    rows = [(i, f.tobytes().hex()) for i, f in enumerate(group)]
    got = {r.doc_id: r.component_id for r in E.near_copies(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert got == {i: 150 * (i // 150) for i in range(300)}
    assert sum(n for name, n in kept.items() if name in ("one", "reached", "two") or name.endswith("-edges")) <= 12 * 300


@pytest.mark.parametrize("n_links", [0, 60, 900])
def test_contracted_components_match_union(spark, n_links):
    from tallyforge.llm import components as C
    from tallyforge.scratch import Scratch

    rng = random.Random(n_links)
    pairs = {tuple(sorted(rng.sample(range(100 * k, 100 * k + 100), 2))) for k in range(3) for _ in range(n_links // 3)}
    more = [(a, a + 50) for a in range(200, 230)] if n_links else []
    scratch = Scratch(spark)
    first = C.contracted_components(spark.createDataFrame(list(pairs), "a long, b long"), scratch)
    want = components(pairs, {x for p in pairs for x in p})
    assert {r.node: r.component for r in first.collect()} == want
    links = {(want.get(a, a), want.get(b, b)) for a, b in [*more, (0, 400), (300, 400)]}
    second = C.merged(first, spark.createDataFrame(list(links), "a long, b long"), scratch, "more")
    want = components([*pairs, *links], {x for p in [*pairs, *links] for x in p})
    rows = [(r.node, r.component) for r in second.collect()]
    assert len(rows) == len(want) and dict(rows) == want


@pytest.mark.parametrize("share", [4096, 3])
def test_stragglers_reach_each_other_and_the_group(spark, monkeypatch, share):
    """Without first tries every link of a shared key is still found: to the largest component, or between others only."""
    from tallyforge.llm import components as C

    monkeypatch.setattr(C, "KEY_SHARE", share)
    monkeypatch.setattr(E, "TRIED", 0)
    rng = np.random.Generator(np.random.PCG64(9))
    group = np.repeat(rng.integers(1, 256, size=(1, 2 * E.WALKS), dtype=np.uint8), 60, axis=0)
    # Members differ in up to 40 bytes, so that many are linked only by others, and some by none.
    for i, n in enumerate(rng.integers(0, 41, size=60)):
        group[i, rng.choice(2 * E.WALKS, n, replace=False)] = rng.integers(1, 256, size=n)
    walks = group.reshape(60, E.WALKS, 2)
    shared = lambda a, b: any((walks[a][own] == walks[b][own]).all() for own in E.band_walks())
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if E.likeness(group[a], group[b]) >= E.LEAST and shared(a, b)]
    rows = [(i, f.tobytes().hex()) for i, f in enumerate(group)]
    got = {r.doc_id: r.component_id for r in E.near_copies(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert got == components(pairs, range(60)) and len(set(got.values())) > 1


def test_recall_of_planted_edits(spark):
    rng = random.Random(14)
    base = [words(rng, rng.choice([40, 120, 400, 3000])) for _ in range(120)]
    # Word substitutions that leave at least 0.75 of the five-word shingles.
    copies = []
    for t in base:
        ws = t.split(" ")
        for i in rng.sample(range(len(ws)), max(1, len(ws) // 40)):
            ws[i] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
        copies.append(" ".join(ws))
    got = {r.doc_id: r.component_id for r in E.near_copies(spark.createDataFrame(print_rows(base + copies), "doc_id long, fingerprint string")).collect()}
    assert sum(got[i] == got[120 + i] for i in range(120)) >= 0.9 * 120
    assert len(set(got.values())) >= 120


# Toxicity


def toxic_corpus(n=600):
    rng = random.Random(6)
    out = []
    for i in range(n):
        ws = words(rng, rng.randint(20, 120)).split()
        y = int(rng.random() < 0.2)
        if y:
            ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "worthless", "scum,"]))
        out.append((i, " ".join(ws), y))
    return out


def test_held_out_accuracy_and_labels_stay_out(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    train = T.training_labels(labels)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in train.collect() if r.doc_id is not None)
    model = T.fit(docs, train)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(got[i].predicted == y for i, y in held)
    assert len(got) == len(rows) and right / len(held) > 0.95
    kept = {r.doc_id for r in T.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic_corpus(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_corpus(200)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = T.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id == 7}
    assert len(same) == 1
    assert T.score(no_docs, model).count() == 0
    assert T.keep_clean(odd_docs, model).columns == odd_docs.columns
    for known in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(1))):
        assert T.score(odd_docs, T.fit(docs, known)).select("score").distinct().count() == 1


def test_ngrams_do_not_cross_texts():
    import pyarrow as pa

    alone = [sorted(b for t, b in zip(*T.ngram_buckets(*T.raw(pa.array([x])), 3)) if t == 0) for x in ("abcd", "xyz", "", "q")]
    text, bucket = T.ngram_buckets(*T.raw(pa.array(["abcd", "xyz", None, "q"])), 3)
    assert [sorted(bucket[text == i].tolist()) for i in range(4)] == alone


# SentencePiece


def all_paths(own, segment):
    def go(i):
        if i == len(segment):
            yield 0.0, ()
            return
        for j in range(i + 1, len(segment) + 1):
            hit = own.pieces.get(segment[i:j])
            if hit:
                for s, p in go(j):
                    yield hit[0] + s, (hit[1], *p)
            elif j == i + 1:
                s0, ids = own.in_bytes(segment[i])
                for s, p in go(j):
                    yield s0 + s, (*ids, *p)

    return sorted(go(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "worthless", "a  b", "x\ny", "naïve 東", "ab, cd."])
def test_nbest_matches_every_path(text):
    own = S.lattice(MODEL, 5)
    every = all_paths(own, S.MARK + text.replace(" ", S.MARK))[:5]
    best, ids, _ = own.encode([text])[0]
    assert [s for s, _ in best] == pytest.approx([s for s, _ in every])
    assert own.decode(ids) == text


def test_vector_and_plain_search_agree():
    own = S.Lattice(MODEL, 3)
    rng = random.Random(8)
    segments = sorted({S.MARK + w for w in words(rng, 800).split()} | {"é" * 9, "東京" * 3 + "x"})
    own.learn(segments)
    for s in segments:
        found = own.search(s)
        k = own.number[s]
        assert own.best[k] == pytest.approx(found[0][0])
        assert own.loss[k] == pytest.approx(found[0][0] - found[1][0]) if len(found) > 1 else own.loss[k] == float("inf")


def test_piece_scores_match_brute_force_and_give_encodings_like_the_library(spark, odd_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(17)
    texts = [words(rng, 300) for _ in range(40)]
    scores = S.piece_scores(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))
    seen = Counter(i for t in texts for w in t.split(" ") for i in model.encode(w))
    counts = np.array([seen[i] + 0.5 for i in range(model.get_piece_size())])
    assert scores == pytest.approx(np.log(counts / counts.sum()), abs=1e-6)
    own = S.Lattice(MODEL, 4, scores)
    pieces = sum(len(ids) for _, ids, _ in own.encode(texts))
    assert 0.95 <= pieces / sum(len(model.encode(t)) for t in texts) <= 1.05
    every = all_paths(own, S.MARK + "shonthe" + S.MARK + "ana")[:4]
    assert [s for s, _ in own.encode(["shonthe ana"])[0][0]] == pytest.approx([s for s, _ in every])


def test_a_worker_holds_one_lattice_per_model_and_n():
    before = len(S._loaded)
    for k in range(3):
        scores = np.full(32000, -1.0 - k)
        own = S.lattice(MODEL, 6, scores)
        assert own is S.lattice(MODEL, 6, scores) and own.scores[5] == -1.0 - k
    assert len(S._loaded) == before + 1


def test_ties_do_not_depend_on_the_block():
    own = [S.Lattice(MODEL, 4, np.full(32000, -1.0)) for _ in range(2)]
    rng = random.Random(18)
    segments = sorted({S.MARK + "".join(rng.choice("the") for _ in range(7)) for _ in range(60)})
    own[0].learn(segments)
    for s in segments:
        own[1].learn([s])
    ids = lambda o, s: list(o.ids[o.begin[o.number[s]] :][: o.count[o.number[s]]])
    assert [ids(own[0], s) for s in segments] == [ids(own[1], s) for s in segments]


def test_nbest_odd_rows(odd_docs, no_docs):
    got = S.nbest_encode(odd_docs).collect()
    texts = Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    own = S.lattice(MODEL, 1)
    assert Counter((r.doc_id, own.decode(r.ids)) for r in got if r.round_trip) == Counter({k: n for k, n in texts.items() if S.MARK not in k[1]})
    assert all(r.scores == sorted(r.scores, reverse=True) and r.best_score == r.scores[0] for r in got)
    assert all(r.n_pieces == 0 and r.scores == [0.0] for r in got if r.doc_id in (0, 1))
    back = {r.doc_id: r.text for r in S.decode(S.nbest_encode(odd_docs)).collect()}
    assert back[7] == [r.text for r in odd_docs.collect() if r.doc_id == 7][0]
    assert S.nbest_encode(no_docs).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    rng = random.Random(9)
    texts = [words(rng, 50) for _ in range(20)]
    once = [(r[0], r[1].tolist()) for r in S.Lattice(MODEL, 4).encode(texts)]
    monkeypatch.setattr(S, "REMEMBERED_CHARS", 10)
    own = S.Lattice(MODEL, 4)
    assert [(r[0], r[1].tolist()) for t in texts for r in own.encode([t])] == once
