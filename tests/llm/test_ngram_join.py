import random
import re
from collections import Counter

from tallyforge.llm import ngram_join

from .conftest import words


def shingle_set(text):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)])


def brute(rows):
    """Components over ids of (id, text) rows, null ids left out."""
    sets = {}
    for i, t in rows:
        if i is not None and (s := shingle_set(t)):
            sets.setdefault(i, []).append(s)
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def near_copies(rng, n_groups=25, copies=6, short=False):
    out, k = [], 0
    passage = words(rng, 60)
    for g in range(n_groups):
        base = words(rng, rng.randint(4, 30) if short else rng.randint(40, 200)).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 9999)}"
            out.append((k, " ".join(own) + (" " + passage if g % 3 == 0 else "")))
            k += 1
    rng.shuffle(out)
    return out


def check(spark, rows):
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = Counter((r.doc_id, r.n_shingles) for r in got)
    assert sizes == Counter((i, len(shingle_set(t))) for i, t in rows)


def test_components_match_brute_force(spark):
    check(spark, near_copies(random.Random(1)))


def test_short_sets_match_brute_force(spark):
    check(spark, near_copies(random.Random(2), short=True))


def test_every_boundary_gives_the_same_links(spark, monkeypatch):
    rows = near_copies(random.Random(3), n_groups=8)
    for boundary in (0, 12, 64):
        monkeypatch.setattr(ngram_join, "choose_boundary", lambda sets, b=boundary: b)
        check(spark, rows)


def test_long_lists_are_dealt_out_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_SHARE", 3)
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 1)
    check(spark, near_copies(random.Random(4), n_groups=4, copies=25))


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ngram_join.link_components(odd_docs)
    want = brute(rows)
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert [r.component_id for r in found if r.doc_id is None] == [7]


def test_empty_table(no_docs):
    assert ngram_join.link_components(no_docs).count() == 0
    assert ngram_join.one_of_each(no_docs).columns == no_docs.columns


def test_one_of_each_keeps_the_smallest_id(odd_docs):
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}


def chained(rng):
    """Texts that share passages, so that the three tries of step one leave links to step two."""
    rows = near_copies(rng, n_groups=10, copies=5)
    core = words(rng, 120).split()
    return rows + [(1000 + k, " ".join(core[k * 3 :] + [f"v{k}x{j}" for j in range(3 * k)])) for k in range(25)]


def test_a_table_unioned_with_itself(spark, monkeypatch):
    rows = chained(random.Random(6))
    for most in (3, 0):
        monkeypatch.setattr(ngram_join.near_candidates, "__defaults__", (most,))
        check(spark, rows + rows)


def test_lists_of_repeated_members_stay_apart(spark):
    members = {1: "AAB", 2: "CCB", 3: "DDEE", 4: "FFGG", 5: "HJ", 6: "HJ"}
    lists = spark.createDataFrame([(k, ord(m), 9, ord(m), k) for k, ms in members.items() for m in ms], "key long, id long, n int, s1 long, pos int")
    assert {r.key for r in ngram_join.telling_lists(lists).select("key").distinct().collect()} == {1, 2, 3, 4, 5}


def test_an_id_keeps_its_other_texts(spark):
    rng = random.Random(7)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    # 2 ties the classes of a and b; its third text is near 4's; 6 has an empty row and a copy; 8 has two texts.
    rows = [(1, a), (2, a), (3, b), (2, b), (2, c), (4, c + " tail"), (5, d), (6, d), (6, ""), (8, words(rng, 30)), (8, words(rng, 31)), (8, None)]
    check(spark, rows)
    got = ngram_join.one_of_each(spark.createDataFrame(rows + rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 5, 8]
