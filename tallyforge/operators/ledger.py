"""Sheets to ledger rows, trust gates, bids and awards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.money import classify_division, classify_extras_status, classify_sheet, division_name, doc_currency, doc_status, doc_unit, is_tax_line, parse_grid_money
from ..functions.text import amount_in_text, comma_cells, document_numbers, fold_accents
from ..scratch import Scratch, shuffled

MONEY = "decimal(18,2)"


def split_workbook_sections(documents: DataFrame) -> DataFrame:
    """(document_id, name, position, sheet, body): the ``### Name`` sections of each text, up to a truncation marker; the whole text without markers."""
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, r"(?m)(?=^### .+$)")
    marked = text.rlike(r"(?m)^### .+$")
    one = documents.withColumn("_p", F.when(marked, F.filter(parts, lambda p: p.rlike(r"^### .+"))).otherwise(F.array(text)))
    rows = one.select("document_id", "name", F.posexplode("_p").alias("position", "_s"), marked.alias("_m"))
    sheet = F.when(F.col("_m"), F.trim(F.regexp_extract("_s", r"^### (.+)", 1)))
    body = F.when(F.col("_m"), F.regexp_replace("_s", r"^### .+\s*|\s+$", "")).otherwise(F.col("_s"))
    cut = F.max(F.coalesce(F.contains(F.lower(sheet), F.lit("sheets omitted")), F.lit(False))).over(Window.partitionBy("document_id").orderBy("position"))
    return rows.withColumns({"sheet": sheet, "body": body, "_cut": cut}).filter(~F.col("_cut")).select("document_id", "name", "position", "sheet", "body")


def grid_lines(sections: DataFrame, *carried: str) -> DataFrame:
    """Cells of every non-blank line: (document_id, position, line, cells) and ``carried`` columns; tab or comma by count over the first 40 lines."""
    split = sections.withColumn("_lines", F.split(F.regexp_replace("body", "\r", ""), "\n"))
    split = split.withColumn("_head", F.array_join(F.slice("_lines", 1, 40), "\n"))
    count = lambda mark: F.length("_head") - F.length(F.replace(F.col("_head"), F.lit(mark), F.lit("")))
    # Cells are split before lines are exploded, else Spark splits a line again to see whether it is blank.
    cells = F.when(count("\t") > count(","), F.transform("_lines", lambda x: F.transform(F.split(x, "\t"), lambda c: F.trim(c)))).otherwise(F.transform("_lines", lambda x: F.transform(comma_cells(x), lambda c: F.trim(c))))
    return split.select("document_id", "position", *carried, F.posexplode(cells).alias("line", "cells")).filter(F.array_join("cells", "") != "")


def _column(header: Column, test) -> Column:
    """Place (0-based) of the first header cell that passes, -1 if none."""
    places = F.filter(F.transform(header, lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, 0), F.lit(-1))


def _cell(cells: Column, place: Column) -> Column:
    return F.when(place >= 0, F.coalesce(F.get(cells, place), F.lit(""))).otherwise("")


def _has(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def parse_quote_grid(lines: DataFrame) -> DataFrame:
    """Rows of quote grids: (document_id, position, line, kind, division_code, amount_type, amount, description, item_ref).

    The header is the first line with a material and a total amount column. Lines
    with material or labour are line items of the section above; a total alone opens
    a section; unlabelled totals are the grand totals (kinds pre_tax and after_tax).
    """
    joined = F.lower(F.array_join("cells", " | "))
    looks = _has(joined, "material") & _has(joined, "total amount")
    key = ["document_id", "position"]
    kind = lambda c: (
        F.when(_has(c, "material"), "material").when(_has(c, "labour", "labor"), "labour").when(_has(c, "total"), "total").when(_has(c, "sow") & _has(c, "ref", "item"), "ref")
        .when(_has(c, "master format", "masterformat") | c.startswith("notes"), "notes").when(_has(c, "description", "item", "phase"), "words").otherwise("")
    )
    low = F.transform("cells", lambda c: F.lower(c))
    over = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    # The least header up to a line is, below it, the header: lines are sorted once for it and for their sections.
    header = F.min(F.when(looks, F.struct("line", low.alias("header"), F.transform(low, kind).alias("kinds")))).over(over)
    body = lines.filter("document_id is not null and position is not null").withColumn("_h", header).filter(F.col("line") > F.col("_h.line"))
    place = lambda name: (F.array_position("_h.kinds", name) - 1).cast("int")
    places = {"_m": place("material"), "_l": place("labour"), "_t": place("total"), "_r": place("ref"), "_n": place("notes"), "_d": F.greatest(place("words"), F.lit(0))}
    body = body.select(*key, "line", "cells", *[p.alias(n) for n, p in places.items()])
    take = lambda p: _cell(F.col("cells"), F.col(p))
    body = body.select(*key, "line", take("_d").alias("desc"), take("_n").alias("notes"), take("_r").alias("ref"), F.array_join("cells", " ").alias("joined"), F.transform(F.array(take("_m"), take("_l"), take("_t")), parse_grid_money).alias("_a"))
    body = body.select("*", *[F.get("_a", i).alias(n) for i, n in enumerate(("material", "labour", "total"))])
    item = F.col("material").isNotNull() | F.col("labour").isNotNull()
    section = ~item & F.col("total").isNotNull() & (F.col("desc") != "") & ~F.col("desc").rlike(R.PRETAX)
    own = F.when(section, classify_division(F.col("notes"), F.col("desc")))
    body = body.withColumn("division_code", F.coalesce(F.last(own, ignorenulls=True).over(over), F.lit(R.UNCLASSIFIED[0])))
    kind = F.when(F.col("desc").rlike(R.CONTINGENCY), "contingency").when(F.col("desc").rlike(R.MARKUP), "markup").when(F.col("desc").rlike(R.GRID_TAX), "tax").otherwise("total")
    text = F.when(F.col("desc") != "", F.col("desc")).otherwise(F.col("notes"))
    out = F.array_compact(F.array(
        F.when(F.col("material").isNotNull(), F.struct(F.lit("line_item").alias("kind"), F.lit("material").alias("amount_type"), F.col("material").alias("amount"))),
        F.when(F.col("labour").isNotNull(), F.struct(F.lit("line_item").alias("kind"), F.lit("labour").alias("amount_type"), F.col("labour").alias("amount"))),
        F.when(section, F.struct(F.lit("division_total").alias("kind"), kind.alias("amount_type"), F.col("total").alias("amount"))),
        F.when(~item & F.col("total").isNotNull() & ~section, F.struct(F.when(F.col("joined").rlike(R.AFTERTAX), "after_tax").when(F.col("joined").rlike(R.PRETAX), "pre_tax").otherwise("other_total").alias("kind"), F.lit("total").alias("amount_type"), F.col("total").alias("amount"))),
    ))
    rows = body.select(*key, "line", "division_code", text.alias("description"), F.col("ref").alias("item_ref"), F.explode(out).alias("o"))
    return rows.select(*key, "line", F.col("o.kind").alias("kind"), "division_code", F.col("o.amount_type").alias("amount_type"), F.col("o.amount").cast(MONEY).alias("amount"), "description", "item_ref")


def reconcile_grid(rows: DataFrame) -> DataFrame:
    """Per sheet the sum of section totals, the stated total before tax and whether they agree to the cent."""
    out = rows.groupBy("document_id", "position").agg(F.sum(F.when(F.col("kind") == "division_total", F.col("amount"))).cast(MONEY).alias("division_total"), F.max(F.when(F.col("kind") == "pre_tax", F.col("amount"))).alias("stated_total"))
    return out.withColumn("reconciled", F.abs(F.col("division_total") - F.col("stated_total")) <= 0.01)


def parse_extras_grid(lines: DataFrame, *, depth: int = 10) -> DataFrame:
    """Change orders: (document_id, position, line, co_number, description, amount, status, division_code); rejected and zero rows are skipped.

    The header (a change order, a total and a status column) is within the first ``depth`` lines; English or French.
    """
    low = F.transform("cells", lambda c: F.lower(fold_accents(c)))
    joined = F.array_join(low, " | ")
    looks = _has(joined, "co", "change order", "change #") & _has(joined, "total") & _has(joined, "status", "statut", "etat")
    key = ["document_id", "position"]
    header = lines.filter((F.col("line") < depth) & looks).groupBy(*key).agg(F.min(F.struct("line", low.alias("header"))).alias("h")).select(*key, F.col("h.line").alias("header_line"), "h.header")
    h = F.col("header")
    number = lambda c: (c == "co") | _has(c, "co #", "co#", "no co", "change")
    words = lambda c: ~number(c) & _has(c, "item", "description", "scope", "work", "travaux", "designation")
    total = lambda c: ~number(c) & ~words(c) & _has(c, "total") & ~_has(c, "cost")
    state = lambda c: ~number(c) & ~words(c) & ~total(c) & _has(c, "status", "statut", "etat")
    at = lambda place, fallback: F.when(place >= 0, place).otherwise(fallback)
    places = header.select(*key, "header_line", at(_column(h, number), F.lit(0)).alias("_c"), at(_column(h, words), F.lit(1)).alias("_d"), at(_column(h, total), F.size(h) - 2).alias("_t"), at(_column(h, state), F.size(h) - 1).alias("_s"))
    body = lines.join(shuffled(places), key).filter(F.col("line") > F.col("header_line"))
    take = lambda p: _cell(F.col("cells"), F.col(p))
    rows = body.select(*key, "line", take("_c").alias("co_number"), take("_d").alias("description"), parse_grid_money(take("_t")).cast(MONEY).alias("amount"), classify_extras_status(take("_s")).alias("status"))
    return rows.filter("amount is not null and amount <> 0 and status is not null").withColumn("division_code", classify_division(F.lit(None).cast("string"), F.concat_ws(" ", "co_number", "description")))


def extras_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("document_id").agg(F.sum(F.when(F.col("status") == "accepted", F.col("amount"))).cast(MONEY).alias("accepted_total"), F.sum(F.when(F.col("status") == "proposed", F.col("amount"))).cast(MONEY).alias("proposed_total"), F.count(F.lit(1)).alias("rows"))


def ledger_from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger rows and one outcome per document (document_id, name, text).

    Sections are typed by name and head; of each type the first of a document is
    parsed, quotes as grids and extras as change orders (as grids if that gives nothing).
    """
    sections = split_workbook_sections(documents)
    typed = sections.withColumn("sheet_type", classify_sheet(F.concat_ws(" ", "name", "sheet"), F.col("body")))
    first = typed.groupBy("document_id", "sheet_type").agg(F.min(F.struct("position", "name", "sheet", "body")).alias("m")).select("document_id", "sheet_type", "m.*").filter(F.col("sheet_type").isin("quote", "extras"))
    # Cells are read twice (as change orders, then as grids), so they are split once and written with their sheet's type.
    lines = Scratch(documents.sparkSession).keep(grid_lines(first, "sheet_type"), "lines")
    changes = lines.filter("sheet_type = 'extras'").drop("sheet_type")
    extras = parse_extras_grid(changes)
    bare = changes.join(shuffled(extras.select("document_id", "position").distinct()), ["document_id", "position"], "left_anti")
    grid = parse_quote_grid(lines.filter("sheet_type = 'quote'").drop("sheet_type")).unionByName(parse_quote_grid(bare)).filter(F.col("kind").isin("line_item", "division_total"))
    named = documents.select("document_id", doc_unit(F.col("name")).alias("unit"), doc_status(F.col("name")).alias("doc_state"), doc_currency(F.col("text")).alias("currency"))
    a = grid.select("document_id", "division_code", "amount_type", "amount", "description", F.lit(None).cast("string").alias("status"), F.lit("grid").alias("source"))
    b = extras.select("document_id", "division_code", F.lit("adjustment").alias("amount_type"), "amount", "description", "status", F.lit("extras").alias("source"))
    rows = a.unionByName(b).join(shuffled(named), "document_id").withColumn("status", F.coalesce("status", "doc_state")).drop("doc_state").withColumn("division_name", division_name(F.col("division_code")))
    counts = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("rows_written"))
    found = typed.groupBy("document_id").agg(F.array_sort(F.collect_set("sheet_type")).alias("types"))
    outcome = documents.select("document_id", "text").join(found, "document_id", "left").join(counts, "document_id", "left")
    state = (
        F.when(F.coalesce("rows_written", F.lit(0)) > 0, "parsed").when(F.coalesce(F.trim("text"), F.lit("")) == "", "skipped:no_text")
        .when(F.arrays_overlap("types", F.array(F.lit("quote"), F.lit("extras"))), "failed:no_grid").otherwise("skipped:unsupported_layout")
    )
    return rows, outcome.select("document_id", state.alias("outcome"), F.coalesce("rows_written", F.lit(0)).alias("rows_written"))


def trust_gate(rows: DataFrame, stated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted rows split into trusted and quarantined (with a reason).

    Tax lines are dropped. A document passes if the sum of its rows, before or after
    tax, is within max(1.00, 1 %) of its stated total and that total stands in its
    text. ``stated``: document_id, stated_total, text.
    """
    tax = is_tax_line(F.col("amount_type"), F.col("description"))
    sums = rows.withColumn("_tax", tax).groupBy("document_id").agg(F.sum(F.when(~F.col("_tax"), F.col("amount"))).cast(MONEY).alias("net"), F.sum("amount").cast(MONEY).alias("gross"))
    slack = F.greatest(F.lit(1).cast(MONEY), (F.abs("stated_total") * F.lit(0.01).cast("decimal(4,2)")).cast(MONEY))
    near = (F.abs(F.col("net") - F.col("stated_total")) <= slack) | (F.abs(F.col("gross") - F.col("stated_total")) <= slack)
    seen = amount_in_text(F.col("stated_total"), document_numbers(F.col("text")))
    reason = F.when(F.col("stated_total").isNull(), "no_stated_total").when(F.col("net").isNull(), "no_rows").when(~near, "sum_mismatch").when(~seen, "total_not_in_evidence")
    judged = sums.join(stated, "document_id", "left").select("document_id", reason.alias("reason"))
    marked = rows.filter(~tax).join(judged, "document_id")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def validate_records(items: DataFrame, texts: DataFrame, *, kinds: tuple[str, ...] = ("total", "line_item", "tax", "deposit", "other"), default: str = "other") -> DataFrame:
    """Extracted items with a readable, non-zero amount: kind held to the vocabulary, grounding flag, rollup flag."""
    cleaned = F.trim(F.regexp_replace("amount_text", "[A-Za-z$,]", "")).try_cast(MONEY)
    kind = F.lower(F.trim("record_kind"))
    joined = items.withColumn("amount", cleaned).filter("amount is not null and amount <> 0").join(texts.select("document_id", "name", "text"), "document_id", "left")
    rollup = F.coalesce(F.col("name").rlike(R.ROLLUP_NAME), F.lit(False)) | F.coalesce(F.substring("text", 1, 8000).rlike(R.PROJECTION_CONTENT), F.lit(False))
    known = F.coalesce(kind.isin(*kinds), F.lit(False))
    return joined.select("document_id", "item_id", "amount", F.when(known, kind).otherwise(default).alias("record_kind"), (~known).alias("kind_warning"), amount_in_text(F.col("amount"), document_numbers(F.col("text"))).alias("verified"), rollup.alias("is_rollup"))


def ledger_health(outcomes: DataFrame) -> DataFrame:
    """One action per document from its outcome, text and extension (document_id, name, has_text, outcome), and the action's rank."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    action = (
        F.when(F.col("outcome") == "parsed", "ok").when(~F.col("has_text") & ext.isin(*R.PHOTO_EXTENSIONS), "safe_skip").when(~F.col("has_text"), "extract_text")
        .when((F.col("outcome") == "failed:no_grid") & ext.isin(*R.PDF_EXTENSIONS), "needs_extractor").when(F.col("outcome") == "failed:no_grid", "fix_layout").otherwise("safe_skip")
    )
    rank = F.when(action == "extract_text", 1).when(action == "fix_layout", 2).when(action == "needs_extractor", 3).when(action == "safe_skip", 4).otherwise(5)
    return outcomes.select("document_id", action.alias("action"), rank.alias("rank"))


def bid_ingest(lines: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bid headers and their quoted cost rows. ``lines``: bid_id, project_id, kind, amount_type, amount, item_code, stated_total; section totals are not written."""
    own = lines.filter("kind = 'line_item'").withColumn("cost_status", F.lit("quoted"))
    covered = own.join(items.select("project_id", "item_code", F.col("id").alias("item_id")), ["project_id", "item_code"], "left")
    rows = covered.select("bid_id", "project_id", "amount_type", "amount", "item_id", "cost_status", (F.col("item_code").isNotNull() & F.col("item_id").isNull()).alias("unresolved"))
    sums = own.groupBy("bid_id").agg(F.sum("amount").cast(MONEY).alias("line_sum"))
    header = lines.groupBy("bid_id", "project_id").agg(F.max("stated_total").alias("stated_total")).join(sums, "bid_id", "left")
    return header.withColumn("reconciled", F.abs(F.col("line_sum") - F.col("stated_total")) <= 1), rows


def po_award(bids: DataFrame, cost_rows: DataFrame, existing: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    """Selected bids with a quoted row and no order yet become orders: order, awarded bid, committed rows and an obligation each.

    ``bids``: id, project_id, status, amount; ``existing``: bid_id, project_id, number.
    """
    from .windows import po_sequence

    quoted = cost_rows.filter("cost_status = 'quoted'")
    able = bids.filter("status = 'selected'").join(quoted.select(F.col("bid_id").alias("id")).distinct(), "id", "left_semi").join(existing.select(F.col("bid_id").alias("id")), "id", "left_anti")
    coded = able.join(projects.select(F.col("id").alias("project_id"), "code"), "project_id")
    orders = po_sequence(coded, existing).join(able.select("id", "amount"), "id").select(F.col("id").alias("bid_id"), "project_id", "number", "amount")
    committed = quoted.join(orders.select("bid_id", "number"), "bid_id").withColumn("cost_status", F.lit("committed"))
    obligations = orders.select(F.sha2(F.concat_ws("/", F.lit("po"), F.col("bid_id").cast("string")), 256).alias("id"), "project_id", F.lit("owed_by_us").alias("direction"), "amount", F.col("number").alias("source_ref"))
    return {"orders": orders, "bids": bids.join(orders.select(F.col("bid_id").alias("id"), F.lit("awarded").alias("new")), "id", "left").withColumn("status", F.coalesce("new", "status")).drop("new"), "cost_rows": committed, "obligations": obligations}
