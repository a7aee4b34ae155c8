"""Operators on small hand-made rows, with results worked out by hand."""

import re
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import money as M
from tallyforge.functions import text as X
from tallyforge.functions.text import comma_cells
from tallyforge.operators import aggregates as A
from tallyforge.operators import graph as G
from tallyforge.operators import joins as J
from tallyforge.operators import ledger as L
from tallyforge.operators import retrieval as R
from tallyforge.operators import windows as W


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expression(F.col("v")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


def test_money_cells(spark):
    cells = ["$26.41", "($5.00)", "-$33.35", "$1,234.56", "1 234,56", "", None, "n/a", "1 234,56", "12,50", "1,500", "3.00-", "1.234,56"]
    want = [26.41, -5.0, -33.35, 1234.56, 1234.56, None, None, None, 1234.56, 12.5, 1500.0, -3.0, 1234.56]
    assert [None if x is None else float(x) for x in column(spark, cells, M.parse_money)] == want


def test_clock_cells(spark):
    assert column(spark, ["7:30 AM", "4pm", "0730", "16h00", "12 am", "25:00", "noon", "730", None], M.parse_clock) == ["07:30", "16:00", "07:30", "16:00", "00:00", None, None, "07:30", None]


def test_names_streets_and_civics(spark):
    assert column(spark, ["5768-5770 St. Laurent (Réno)", None], X.normalize_name) == ["5768 5770 st laurent reno", ""]
    assert column(spark, ["5768 St-Laurent", "SAINT LAUR", "12 rue A1"], X.street_signature) == ["stlaurent", "stlaur", ""]
    assert column(spark, ["1455 Rue X", "5768-5770 St L", "25-1001 580 Rue Viau", "01. PROJECTS"], X.civic_numbers) == [["1455"], ["5768", "5770"], [], []]


@pytest.mark.parametrize("text, amount, found", [("Total $1 080.00", "1080.00", True), ("17 384,91 $", "17384.91", True), ("about 8k", "8000", True), ("1.2m", "1200000", True), ("923,44", "923.44", True), ("$3,600.00", "3600", True), ("credit -250.00", "-250.00", True), ("nothing", "5", False), ("1 500,00", "500.00", True)])
def test_amount_grounding(spark, text, amount, found):
    df = R.amount_grounding(spark.createDataFrame([(1, Decimal(amount))], "document_id int, amount decimal(14,2)"), spark.createDataFrame([(1, text)], "document_id int, text string"))
    assert df.first().found is found


def test_quote_grid_is_the_same_in_csv_and_tsv(spark):
    head = ["Description", "Notes/ Master Format values", "", "Material Amount (CAD)", "Labour Amount (CAD)", "Total Amount (CAD)"]
    body = [["Demolition", "Div. 02", "", "", "", "$1,000.00"], ["    Selective demo", "02 41 19", "", "$400.00", "$600.00", ""], ["Plumbing", "Div. 22", "", "", "", "$500.00"], ["", "", "Pre-Tax Total", "", "", "$1,500.00"]]
    quoted = "\n".join(",".join(f'"{c}"' if "," in c else c for c in r) for r in [head, *body])
    tabbed = "\n".join("\t".join(r) for r in [head, *body])
    docs = spark.createDataFrame([(1, "a quote", quoted), (2, "a quote", tabbed), (3, "job costing", "Material Budget,Cost\n1,2")], "document_id int, name string, text string")
    rows = L.parse_quote_grid(L.grid_lines(L.split_workbook_sections(docs)))
    by = {d: Counter((r.kind, r.division_code, r.amount_type, float(r.amount)) for r in rows.collect() if r.document_id == d) for d in (1, 2, 3)}
    assert by[1] == by[2] == Counter({("division_total", "02", "total", 1000.0): 1, ("line_item", "02", "material", 400.0): 1, ("line_item", "02", "labour", 600.0): 1, ("division_total", "22", "total", 500.0): 1, ("pre_tax", "22", "total", 1500.0): 1})
    assert not by[3]
    assert {(r.document_id, r.reconciled) for r in L.reconcile_grid(rows).collect()} == {(1, True), (2, True)}


@pytest.mark.parametrize("head, states", [("CO #,Item,Cost/Unit,Applied,Total,Status", ("Accepted", "Accepted", "Not Accepted", "Accepted", "Proposed")), ("NO CO,Description des travaux,Prix unitaire,x,Total,Statut", ("Accepté", "Accepte", "Non accepté", "accepté", "Proposé"))])
def test_change_orders(spark, head, states):
    lines = [f"{i},door,1,1,{t}.00,{s}" for i, (t, s) in enumerate(zip((500, 300, 800, 250, 100), states))]
    docs = spark.createDataFrame([(1, "EXTRAS", "\n".join([head, *lines]))], "document_id int, name string, text string")
    total = L.extras_totals(L.parse_extras_grid(L.grid_lines(L.split_workbook_sections(docs)))).first()
    assert (float(total.accepted_total), float(total.proposed_total), total.rows) == (1050.0, 100.0, 4)


def test_network_of_four_tasks(spark):
    tasks = spark.createDataFrame([(1, i, float(d)) for i, d in enumerate((2, 4, 3, 2))], "project_id int, id int, expected double")
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3)], "project_id int, predecessor_id int, successor_id int")
    done = {r.id: r for r in G.free_float(G.cpm_backward(G.cpm_forward(tasks, edges), edges), edges).collect()}
    assert done[3].early_finish == 8.0 and [i for i, r in sorted(done.items()) if r.critical] == [0, 1, 3]
    assert (done[2].total_float, done[2].free_float) == (1.0, 1.0)
    assert [r.path for r in G.longest_path(tasks.withColumn("variance", F.lit(1.0)), edges).collect()] == [[0, 1, 3]]
    cyclic = edges.unionByName(spark.createDataFrame([(1, 3, 1)], edges.schema))
    assert {r.id for r in G.cycle_check(tasks, cyclic).collect()} == {1, 3}
    assert {r.id for r in G.acyclic(tasks, cyclic)[0].collect()} == {0, 2}


def test_null_cost_status_is_actual_and_totals_win(spark):
    rows = [(1, 10, "A", "09", "cost", "total", 100, None, None), (1, 10, "A", "09", "cost", "material", 60, None, None), (1, 11, "A", "09", "cost", "tax", 5, None, "actual"), (1, 12, "A", "09", "cost", "total", 70, None, "committed"), (1, 13, "A", "09", "revenue", "total", 300, "accepted", None), (1, 14, "A", "09", "revenue", "adjustment", 40, "proposed", None), (1, 15, "A", "09", "revenue", "adjustment", 9, "superseded", None)]
    df = spark.createDataFrame([(*r[:6], Decimal(r[6]), *r[7:]) for r in rows], "project_id int, document_id int, unit string, division_code string, side string, amount_type string, amount decimal(14,2), status string, cost_status string")
    r = A.division_margins(df).first()
    assert (float(r.quoted_revenue), float(r.proposed_revenue), float(r.actual_total_cost), float(r.pipeline_cost), float(r.gross_margin), r.gross_margin_pct, r.status_flag) == (300.0, 40.0, 105.0, 70.0, 195.0, 65.0, "ok")


def test_twins_are_paired_once_in_date_order(spark):
    rows = [(1, False, 5, date(2026, 1, 1)), (2, False, 5, date(2026, 1, 3)), (11, True, 5, date(2026, 1, 2)), (12, True, 5, date(2026, 1, 3)), (13, True, 5, date(2026, 1, 3)), (14, True, 6, date(2026, 1, 3))]
    df = spark.createDataFrame([(i, on, Decimal(t), d, False, None, None) for i, on, t, d in rows], "id long, online boolean, total decimal(14,2), sales_date date, is_refund boolean, project_id long, duplicate_of long")
    assert {(r.primary, r.duplicate, r.days) for r in J.duplicate_twins(df).collect()} == {(1, 11, 1), (2, 12, 0)}


def test_close_totals_meet_in_bands(spark):
    rows = [(i, Decimal(str(t))) for i, t in enumerate((100, 101, 100.4, 1000, 1004.9, 1005.1, 250_000, 251_250, 251_251, 3, 4, 4.01, 0.5))]
    df = spark.createDataFrame([(1, i, t, False) for i, t in rows], "project_id int, document_id int, total decimal(14,2), is_rollup boolean")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and abs(a - b) <= max(Decimal(1), abs(a) * Decimal("0.005"))}
    assert {(r.a, r.b) for r in J.duplicate_totals(df).collect()} == want


def test_unresolved_is_better_than_wrong(spark):
    projects = spark.createDataFrame([(1, "5768 St-Laurent", "C1"), (2, "3940 Cote des Neiges", "C2"), (3, "12 St-Mathieu", "C3")], "id int, name string, code string")
    jobs = spark.createDataFrame([("0",), ("3940",), ("STL-GIFT",), ("STA",), ("ONLINE ORDER",), ("c3",), ("SAINT LAUR",)], "key string")
    got = {r.key: (r.target, r.method) for r in J.job_to_project(jobs, projects).collect()}
    assert got == {"0": (None, "unresolved"), "3940": (2, "job_phrase"), "STL-GIFT": (1, "street_prefix"), "STA": (None, "unresolved"), "ONLINE ORDER": (None, "unresolved"), "c3": (3, "job_name"), "SAINT LAUR": (1, "street_prefix")}


def test_chunks_cover_the_text_and_overlap():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 120 for i in range(12))
    chunks = R.chunk_text(text, 300, 20)
    assert all(len(c) // 4 <= 300 + 20 + 160 for c in chunks) and all(f"Paragraph {i}." in "".join(chunks) for i in range(12))
    assert chunks[1].startswith(chunks[0][-80:].lstrip())
    assert R.chunk_text(None) == R.chunk_text("  ") == []
    assert [len(c) for c in R.chunk_text("x" * 5000, 100, 0)] == [400] * 12 + [200]


def test_ranks_within_groups_without_one_big_window(spark):
    rows = spark.createDataFrame([(g, i, (i * 7919) % 101) for g in range(3) for i in range(100)], "g int, i int, v int")
    got = {(r.g, r.i): r["rank"] for r in W.distributed_rank(rows, [F.desc("v"), F.asc("i")], by=("g",), partitions=7).collect()}
    for g in range(3):
        order = sorted(range(100), key=lambda i: (-((i * 7919) % 101), i))
        assert [got[g, i] for i in order] == list(range(100))


def test_files_name_projects_and_vendors(spark):
    files = spark.createDataFrame([(1, "2026001_QUOTE_09-Finishes_ABCTile_pending.xlsx"), (2, "2026001-001_PO_22-Plumbing_PlombertInc_awarded.xlsx"), (3, "2026001_SOW_v1.xlsx"), (4, "notes.txt")], "id int, name string")
    projects = spark.createDataFrame([(7, "2026001")], "id int, code string")
    vendors = spark.createDataFrame([(1, "ABC Tile"), (2, "Groupe Plombert Inc."), (3, "Other")], "id int, name string")
    packages = spark.createDataFrame([(70, 7, "09"), (71, 7, "22"), (72, 7, "22"), (80, 8, "09")], "id int, project_id int, division_code string")
    got = {r.id: (r.code, r.sequence, r.doc_type, r.division, r.trade, r.status, r.project_id, r.vendor_id, r.vendor_method, r.package_id, r.package_method) for r in J.filename_resolver(files, projects, vendors, packages).collect()}
    assert got == {
        1: ("2026001", None, "QUOTE", "09", "Finishes", "pending", 7, 1, "exact", 70, "filename_division_code"), 2: ("2026001", "001", "PO", "22", "Plumbing", "awarded", 7, 2, "contains", None, "ambiguous"),
        3: ("2026001", None, "SOW", None, None, "v1", 7, None, None, None, "unresolved"), 4: (None, None, None, None, None, None, None, None, None, None, "unresolved"),
    }


def plain_chunks(text, target, overlap):
    """Packing by trial: add the next piece while the estimate stays within the target."""
    import re

    tokens = lambda t: max(1, len(t) // 4) if t else 0
    pieces = []
    for p in re.split("\n\n", text.replace("\r\n", "\n")):
        p = p.strip()
        if p and tokens(p) <= target:
            pieces.append(p)
        elif p:
            rest = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", p) if s.strip()]
            while rest:
                n = 1
                while n < len(rest) and tokens(" ".join(rest[: n + 1])) <= target:
                    n += 1
                run, rest = " ".join(rest[:n]), rest[n:]
                step = len(run) if tokens(run) <= target else max(200, 4 * target)
                pieces += [run[i : i + step] for i in range(0, len(run), step)]
    out = []
    while pieces:
        tail = out[-1][-4 * overlap :].lstrip() if out and overlap else ""
        n = 1
        while n < len(pieces) and tokens(tail) + sum(map(tokens, pieces[: n + 1])) <= target:
            n += 1
        out.append("\n\n".join(([tail] if tail else []) + pieces[:n]))
        pieces = pieces[n:]
    return out


def test_chunks_match_packing_by_trial():
    import random

    from tallyforge.operators.retrieval import chunk_text

    rng = random.Random(1)
    bits = ["word ", "a. ", "b! ", "\n", "\n\n", "x" * 30, " ", "zz\r\n\r\n", "  \n\n ", "longword" * 20]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))
        for target, overlap in ((20, 5), (50, 0), (500, 50)):
            assert chunk_text(text, target, overlap) == plain_chunks(text, target, overlap)
    assert chunk_text(None) == []


def test_chunk_tables_and_what_changed(spark):
    from tallyforge.operators.retrieval import chunk_documents, incremental_chunks

    texts = [(i, f"Part {i}. " + "Some words here. " * (40 * i)) for i in range(6)] + [(6, None), (7, " ")]
    chunks = chunk_documents(spark.createDataFrame(texts, "document_id long, text string"), target=60, overlap=5)
    want = [(i, k, c) for i, t in texts for k, c in enumerate(plain_chunks(t or "", 60, 5))]
    assert sorted((r.document_id, r.chunk_index, r.text) for r in chunks.collect()) == want
    import hashlib

    mark = lambda c: hashlib.sha256(f"{c}|hash|64".encode()).hexdigest()
    stored = [(i, [mark(c) for c in plain_chunks(t or "", 60, 5)]) for i, t in texts[:5]]
    stored[2] = (2, stored[2][1][:-1])
    again = incremental_chunks(chunks, spark.createDataFrame(stored, "document_id long, hashes array<string>"))
    assert {r.document_id for r in again.collect()} == {2, 5}


def test_jobs_meet_projects_by_whole_phrases_and_prefixes_either_way(spark):
    from tallyforge.operators.joins import job_to_project

    projects = spark.createDataFrame([(1, "5768 St-Laurent", "J1"), (2, "12 Rue Matane", "J22"), (3, "Old Mill Yard", "J3"), (4, "Old Mill", "J4"), (5, "99 Oak", "J5")], "id long, name string, code string")
    jobs = ["STL-GIFT", "saint laurent east", "matanetown", "the old mill yard job", "mill yard", "old", "J22 tools", "st", "", "oakland", "Old Mill"]
    got = {r.key: (r.target, r.method) for r in job_to_project(spark.createDataFrame([(j,) for j in jobs], "key string"), projects).collect()}
    assert got == {
        "STL-GIFT": (1, "street_prefix"), "saint laurent east": (1, "street_prefix"), "matanetown": (2, "street_prefix"), "the old mill yard job": (3, "job_phrase"), "mill yard": (3, "job_phrase"),
        "old": (3, "job_phrase"), "J22 tools": (2, "job_code"), "st": (1, "job_phrase"), "": (None, "unresolved"), "oakland": (5, "street_prefix"), "Old Mill": (4, "job_name"),
    }


def test_twins_match_a_plain_loop(spark):
    import datetime
    import random

    from tallyforge.operators.joins import duplicate_twins

    rng = random.Random(2)
    day = datetime.date(2026, 1, 1)
    rows = [(i, float(rng.choice([10, 20])), False, rng.choice([1, None]), rng.random() < 0.5, day + datetime.timedelta(rng.randint(0, 12)), None) for i in range(80)]
    got = {(r.primary, r.duplicate) for r in duplicate_twins(spark.createDataFrame(rows, "id long, total double, is_refund boolean, project_id long, online boolean, sales_date date, duplicate_of long")).collect()}
    used, want = set(), set()
    for s in sorted((r for r in rows if not r[4]), key=lambda r: (r[5], r[0])):
        for o in sorted((r for r in rows if r[4]), key=lambda r: (r[5], r[0])):
            if o[0] not in used and o[1] == s[1] and o[3] == s[3] and abs((o[5] - s[5]).days) <= 2:
                used.add(o[0])
                want.add((s[0], o[0]))
                break
    assert got == want and want


def test_commas_in_quotes_do_not_separate(spark):
    lines = ["", "a", 'a,"b,c",d', ',"",', '"x, y", z ,', 'a"b,c', '"a,b', " , "]
    want = [[re.sub('^"|"$', "", c.strip(" ")) for c in re.split(r',(?=(?:[^"]*"[^"]*")*[^"]*$)', line)] for line in lines]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    assert [r.cells for r in df.select("i", comma_cells(F.col("line")).alias("cells")).orderBy("i").collect()] == want
    long = spark.createDataFrame([(",".join(f'"{i},"' for i in range(100_000)),)], "line string")
    assert long.select(F.size(comma_cells(F.col("line")))).first()[0] == 100_000


def test_lines_are_numbered_across_blocks_of_a_file(spark, tmp_path):
    from tallyforge.sources.readers import scan_delimited

    for name, mark, end in (("a", ",", "\n"), ("b", "\t", "\r\n")):
        (tmp_path / f"{name}.csv").write_bytes((end.join([f"name{mark}amount"] + ["" if i % 5 == 0 else f"x{i}{mark}{i}" for i in range(1, 1000)]) + end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {(r.file[-5], r.line, tuple(r.cells), tuple(r.header)) for r in scan_delimited(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f, i, (f"x{i}", str(i)), ("name", "amount")) for f in "ab" for i in range(1, 1000) if i % 5}


def method_sizes(spark, df):
    """Bytes of the largest method that Spark writes for each stage of a plan; the JVM compiles none of over 8,000."""
    debug = spark._jvm.org.apache.spark.sql.execution.debug
    stages = getattr(debug, "package$").__getattr__("MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]


def test_grids_are_read_once_by_code_that_is_compiled(spark):
    sheet = "x\nDescription,Notes,Material Amount,Labour Amount,Total Amount\nTiles,,,,5\n a,,1,,\nMisc,Div. 22,,,(7)\n" + '"b, c",,"$1,000.50",(2),\n,,,,\nMaterial,,,,Total Amount\n,,Grand,,9'
    docs = spark.createDataFrame([(1, "q", sheet), (2, "q", sheet.replace("\n", "\r\n")), (3, "q", "nothing"), (4, "q", None), (None, "q", sheet)], "document_id int, name string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = L.parse_quote_grid(L.grid_lines(L.split_workbook_sections(docs)))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("posexplode") == 2
        assert max(method_sizes(spark, rows)) < 8000
        got = Counter((r.document_id, r.line, r.kind, r.division_code, r.amount_type, str(r.amount), r.description) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    one = [(2, "division_total", "09", "total", "5.00", "Tiles"), (3, "line_item", "09", "material", "1.00", "a"), (4, "division_total", "22", "total", "-7.00", "Misc"), (5, "line_item", "22", "material", "1000.50", "b, c"), (5, "line_item", "22", "labour", "-2.00", "b, c"), (8, "other_total", "22", "total", "9.00", "")]
    one[-1] = (8, "pre_tax", *one[-1][2:])
    assert got == Counter((d, *r) for d in (1, 2) for r in one)


def test_divisions_by_code_hint_and_text(spark):
    cases = [("Div. 9", "plumbing", "09"), ("1012", None, "10-12"), ("77", "demo of walls", "02"), ("tiles", "plumbing", "09"), ("", "PLUMBING", "22"), (None, "Profits", "01"), (None, None, "99"), ("  ", "nothing", "99"), ("x", "demolitions", "02")]
    df = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, hint string, text string")
    done = df.select("k", M.classify_division(F.col("hint"), F.col("text")).alias("d"))
    assert [r.d for r in done.orderBy("k").collect()] == [c[2] for c in cases]


def test_ledger_reads_documents_once_for_their_lines(spark):
    grid = "Description,Notes,Material Amount,Labour Amount,Total Amount\nTiles,,,,5\n a,,1,2,"
    orders = "CO #,Item,Cost,Total,Status\n1,door,1,10,Accepted\n2,door,1,20,"
    rows = [
        (1, "101 QUOTE", grid), (2, "Extras", orders), (3, "extras", grid), (4, "101 accepted quote", f"### Quote\n{grid}\n### Extras\n{orders}\n### Quote B\n{grid}"), (5, "plan", "\n" * 7 + "an estimate\n" + grid), (6, "plan", "\n" * 8 + "an estimate\n" + grid),
        (7, "quote", "USD\n" + grid), (8, "quote", "\n" * 20 + "USD\n" + grid), (9, "job costing quote", grid), (10, "quote", None),
    ]
    docs = spark.createDataFrame(rows, "document_id int, name string, text string")
    found, outcome = L.ledger_from_documents(docs)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Lines come from what was written; the documents' own rows are read for units and currency alone.
    assert "posexplode" not in plan and plan.count("BroadcastHashJoin") == 0
    got = Counter((r.document_id, r.source, r.amount_type, float(r.amount), r.division_code, r.status, r.currency) for r in found.collect())
    sheet = lambda d, status="unknown", currency="CAD": {(d, "grid", "total", 5.0, "09", status, currency): 1, (d, "grid", "material", 1.0, "09", status, currency): 1, (d, "grid", "labour", 2.0, "09", status, currency): 1}
    change = lambda d, second: {(d, "extras", "adjustment", 10.0, "08", "accepted", "CAD"): 1, (d, "extras", "adjustment", 20.0, "08", second, "CAD"): 1}
    assert got == Counter(sheet(1) | change(2, "unknown") | sheet(3) | change(4, "unknown") | sheet(4, "accepted") | sheet(5) | sheet(7, currency="USD") | sheet(8))
    assert {r.document_id: (r.outcome, r.rows_written) for r in outcome.collect()} == {1: ("parsed", 3), 2: ("parsed", 2), 3: ("parsed", 3), 4: ("parsed", 5), 5: ("parsed", 3), 6: ("skipped:unsupported_layout", 0), 7: ("parsed", 3), 8: ("parsed", 3), 9: ("skipped:unsupported_layout", 0), 10: ("skipped:no_text", 0)}
