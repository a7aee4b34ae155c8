"""Joins by contained text and by edits, and search, against all pairs."""

import math
import random
from difflib import SequenceMatcher

import pytest

from tallyforge.operators import joins as J
from tallyforge.operators import retrieval as R
from tallyforge.operators import textjoin as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def mutated(rng, text, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(text) + 1), rng.random()
        text = text[:at] + (rng.choice("abcé #") if kind < 0.7 else "") + text[at + (kind > 0.3) :]
    return text


@pytest.mark.parametrize("most", [X.MOST_BYTES, 0])
def test_contained_text_is_every_pair(spark, monkeypatch, most):
    monkeypatch.setattr(X, "MOST_BYTES", most)
    rng = random.Random(1)
    hays = ["customer#" + str(k).zfill(5) for k in range(60)] + ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", "aa", "Rocklands Site"]
    needles = ["customer", "er#000", "#00012", "a", "é", "ab", "abc", "aaa", "Rockland", "zz", "", None] + ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    got = X.contained(spark.createDataFrame([(x, 1) for x in needles], "k string, hay int"), "k", spark.createDataFrame([(x, 2) for x in hays], "n string, needle int"), "n")
    assert sorted((r.needle, r.hay) for r in got.collect()) == sorted({(k, n) for k in needles for n in hays if k and n and k in n})
    assert X.contained(spark.createDataFrame([], "k string"), "k", spark.createDataFrame([("a",)], "n string"), "n").count() == 0


@pytest.mark.parametrize("ratio, threshold", [(False, 0.85), (False, 0.6), (True, 0.85), (True, 0.75)])
def test_near_texts_lose_no_pair(spark, ratio, threshold):
    rng = random.Random(7)
    base = ["customer number " + str(k).zfill(6) for k in range(25)] + ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 24))) for _ in range(40)]
    left = base[::2] + [mutated(rng, t, rng.randint(1, 4)) for t in base] + [base[0][2:-2], "", None]
    right = base + ["x" + base[3] + "y", base[0]]
    k, _ = X.edits(threshold, ratio)
    got = {(r.a, r.b) for r in X.near_texts(*(spark.createDataFrame([(t,) for t in side], "text string") for side in (left, right)), threshold=threshold, ratio=ratio).collect()}
    score = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if ratio else (lambda a, b: 1 - distance(a, b) / max(len(a), len(b), 1))
    pairs = {(a, b) for a in left for b in right if a is not None}
    assert {(a, b) for a, b in pairs if score(a, b) >= threshold} <= got
    most = lambda a, b: math.floor((len(a) + len(b) if ratio else max(len(a), len(b))) * (1 - threshold + 1e-9))
    assert got <= {(a, b) for a, b in pairs if distance(a, b) <= most(a, b)}


@pytest.mark.parametrize("ratio", [False, True])
def test_fuzzy_match_is_the_best_of_all_pairs(spark, ratio):
    rng = random.Random(3)
    right = [(i, "depot street " + str(i).zfill(4), rng.choice(["acme", "acme ltd", "zeta"])) for i in range(50)] + [(90, None, "acme"), (91, "depot street 0007", "acme")]
    left = [(1000 + i, mutated(rng, n or "q", rng.randint(0, 3)).upper(), mutated(rng, c, rng.randint(0, 1))) for i, n, c in right] * 2 + [(2000, None, "acme"), (2001, " Depot Street 0007 ", None)]
    like = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if ratio else (lambda a, b: 1 - distance(a, b) / max(len(a), len(b), 1))
    clean = lambda t: t.strip(" ").lower()
    want = []
    for key, n, c in left:
        scores = [(min(like(clean(n), clean(m)), like(clean(c), clean(d))), -i) for i, m, d in right if n is not None and c is not None and m is not None]
        if scores and max(scores)[0] >= 0.8:
            want.append((key, -max(scores)[1], round(max(scores)[0], 9)))
    got = J.fuzzy_match(spark.createDataFrame(left, "key long, name string, client string"), spark.createDataFrame(right, "id long, name string, client string"), ["name", "client"], threshold=0.8, ratio=ratio)
    assert sorted((r.key, r.target, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_parts_of_names_reach_their_project(spark):
    projects = spark.createDataFrame([(1, "2026001", "923-927 Rockland", "923", ["The Rock"]), (2, "2026002", "Rocklands Site", None, None), (3, "2026003", "North", "77", [])], "id long, code string, name string, legacy_number string, aliases array<string>")
    refs = ["2", " 2026001 ", "923", "the rock", "ROCKLAND", "site", "nowhere", "", "77"]
    got = {r.key: (r.target, r.method) for r in J.resolve_project_ref(spark.createDataFrame([(r,) for r in refs], "key string"), projects).collect()}
    assert got == {"2": (2, "id"), " 2026001 ": (1, "code"), "923": (1, "legacy_number"), "the rock": (1, "alias"), "ROCKLAND": (1, "name"), "site": (2, "name"), "nowhere": (None, "unresolved"), "": (None, "unresolved"), "77": (3, "legacy_number")}
    sites = spark.createDataFrame([("Rockland",), ("at the Rocklands Site gate",), ("yard",)], "key string")
    found = {r.key: (r.target, r.method) for r in J.site_resolution(sites, projects, spark.createDataFrame([("yard", 9)], "key string, project_id long")).collect()}
    assert found == {"Rockland": (1, "site_name"), "at the Rocklands Site gate": (2, "site_name"), "yard": (9, "hint")}
    messages = spark.createDataFrame([(1, 5, "we are at rockland."), (2, 5, "the rocklands site today"), (3, 5, "rocklandish"), (4, 6, None)], "id long, sender long, text string")
    none = spark.createDataFrame([], "sender long, project_id long")
    votes = spark.createDataFrame([(5, 3)], "sender long, project_id long")
    assert {r.key: (r.target, r.method) for r in J.sender_attribution(messages, projects, none, votes).collect()} == {1: (1, "text_match_word"), 2: (2, "text_match"), 3: (3, "sender_recency"), 4: (None, "unresolved")}
    mails = spark.createDataFrame([(1, "a@x", "log+2026003@y"), (2, "a@x", "log+rocklands@y"), (3, "b@x", "log@y")], "id long, sender string, recipient string")
    routed = {r.id: (r.project_id, r.method) for r in J.mail_routing(mails, projects, spark.createDataFrame([("b@x", 3)], "sender string, project_id long")).collect()}
    assert routed == {1: (3, "plus_tag"), 2: (2, "plus_tag"), 3: (3, "sender_default")}


def plain_search(queries, chunks, top_k, least):
    import re

    tokens = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) >= 2}

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) + 0.0 if size else 0.0

    out = []
    for q, qv, qt in queries:
        asked = tokens(qt)
        scored = [(i, cosine(qv, v), round(len(asked & tokens(t)) / len(asked), 6) if asked and tokens(t) else 0.0) for i, v, t in chunks]
        ranks = [{x[0]: k for k, x in enumerate(sorted(scored, key=lambda x: (-x[c], x[0])))} for c in (1, 2)]
        fused = [(-round(1 / (60 + ranks[0][i]) + 1 / (60 + ranks[1][i]), 9), i, s, k) for i, s, k in scored if s >= least or k > 0]
        out += [(q, i, s, k, -f, n) for n, (f, i, s, k) in enumerate(sorted(fused)[:top_k], 1)]
    return sorted(out)


@pytest.mark.parametrize("top_k, least, most, at_once", [(5, 0.0, 2000, 2048), (2, 0.9, 2, 7), (12, -1.0, 3, 50)])
def test_search_equals_ranking_all_chunks(spark, monkeypatch, top_k, least, most, at_once):
    monkeypatch.setattr(R, "MOST_QUERIES", most)
    monkeypatch.setattr(R, "CHUNKS_AT_ONCE", at_once)
    rng = random.Random(top_k)
    vector = lambda: [float(rng.randint(-3, 3)) for _ in range(4)]
    chunks = [(i, vector(), " ".join(rng.choice(["roof", "wall", "door", "paint", "xx"]) for _ in range(rng.randint(0, 4)))) for i in rng.sample(range(5000), 700)]
    chunks += [(6000, None, "roof"), (6001, [1.0], "door"), (6002, [0.0] * 4, None)]
    queries = [(k, vector(), t) for k, t in enumerate(["roof door", "paint", "", "nothing here", "wall wall roof"])] + [(9, None, "door"), (10, [0.0] * 4, None)]
    df = spark.createDataFrame(chunks, "id long, embedding array<double>, text string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id int, embedding array<double>, query_text string")
    got = sorted(tuple(r) for r in R.hybrid_search(asked, df, top_k=top_k, min_similarity=least).collect())
    assert got == plain_search(queries, chunks, top_k, least)
    assert R.hybrid_search(asked, df.limit(0)).count() == 0 and R.hybrid_search(asked.limit(0), df).count() == 0


def test_names_and_projects_of_one_civic_number_are_not_paired(spark, monkeypatch):
    projects = spark.createDataFrame([(i, "100 Rue Saint Paul") for i in range(300)] + [(900, "200-202 Depot"), (901, "300 Mill"), (902, "Yard"), (903, "yard!")], "id long, name string")
    names = spark.createDataFrame([(f"100 site {i}",) for i in range(300)] + [("200 north",), ("300-100 x",), ("100-101 rue saint paul",), ("100 rue saint paul",), ("YARD",), ("202 300",), (None,), ("",)], "key string")
    found = []
    join = J.precedence_join
    monkeypatch.setattr(J, "precedence_join", lambda keys, tiers: (found.extend(t.candidates.count() for t in tiers), join(keys, tiers))[1])
    got = {r.key: (r.target, r.method) for r in J.civic_match(names, projects).collect()}
    # Two projects at most for each number of a name, and for its text.
    assert found[0] <= 2 * (300 + 7) and found[1] <= 2 * 8
    assert {k: v for k, v in got.items() if not (k or "").startswith("100 site")} == {"200 north": (900, "civic"), "300-100 x": (None, "unresolved"), "100-101 rue saint paul": (None, "unresolved"), "100 rue saint paul": (None, "unresolved"), "YARD": (None, "unresolved"), "202 300": (None, "unresolved"), None: (None, "unresolved"), "": (None, "unresolved")}
    assert len(got) == 308 and all(v == (None, "unresolved") for k, v in got.items() if (k or "").startswith("100 site"))


def test_references_and_projects_are_joined_without_the_driver(spark, monkeypatch):
    """Files of a few MB hold a million projects: neither they nor needles of many rows go to the driver."""
    from tallyforge import scratch

    monkeypatch.setattr(X, "MOST_BYTES", 2000)
    plans = []
    keep = scratch.Scratch.keep
    monkeypatch.setattr(scratch.Scratch, "keep", lambda self, df, name: (plans.append(df), keep(self, df, name))[1])
    projects = spark.createDataFrame([(i, f"J{i}", f"Customer#{i:06d}", f"old-{i}", ["x", f"The {i}"]) for i in range(200)], "id long, code string, name string, legacy_number string, aliases array<string>")
    refs = [("7",), ("j9",), (" OLD-11 ",), ("the 13",), ("X",), ("OMER#000150",), ("0001",), ("19",), ("none",), ("",), (None,)] + [(f"R#{i:06d}",) for i in range(100)]
    done = J.resolve_project_ref(spark.createDataFrame(refs, "key string"), projects)
    plans.append(done)
    joins = [df._jdf.queryExecution().sparkPlan().toString() for df in plans]
    assert not sum(text.count("BroadcastHashJoin") for text in joins)
    got = {r.key: (r.target, r.method) for r in done.collect()}
    assert {k: v for k, v in got.items() if not (k or "").startswith("R#")} == {
        "7": (7, "id"), "j9": (9, "code"), " OLD-11 ": (11, "legacy_number"), "the 13": (13, "alias"), "X": (0, "alias"), "OMER#000150": (150, "name"), "0001": (1, "name"), "19": (19, "id"),
        "none": (None, "unresolved"), "": (None, "unresolved"), None: (None, "unresolved"),
    }
    assert all(got[f"R#{i:06d}"] == (i, "name") for i in range(100))
