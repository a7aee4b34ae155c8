"""Sources: tables, delimited text, board JSON, accounting JSON, files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.money import map_status_labels, parse_date_multi, parse_money
from ..functions.text import comma_cells

MONEY = "decimal(14,2)"


def scan_table(spark: SparkSession, path: str, *, schema: StructType | None = None, trashed: str | None = "is_trashed", include_trashed: bool = False) -> DataFrame:
    """A table with its declared schema; rows in the trash are left out at the scan unless asked for."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if include_trashed or trashed is None or trashed not in df.columns else df.filter(~F.col(trashed))


def scan_delimited(spark: SparkSession, path: str, *, head: int = 20) -> DataFrame:
    """(file, line, cells, header, confidence) of the data lines of delimited files.

    Per file the delimiter is tab or comma, whichever is more frequent in the head.
    The header is the best scored of the head's lines: filled cells that are text;
    confidence falls with its score (1.0, 0.8, 0.5, 0.3).
    """
    # A line's number is its place in its block of the file after the lines of the blocks before, so no task needs a whole file.
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r", "").alias("text"), F.monotonically_increasing_id().alias("place")
    )
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("file", "block", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("place")) - 1
    lines = raw.withColumn("inside", inside).join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).cast("int").alias("line"), "text")
    marks = lambda m: F.sum(F.length("text") - F.length(F.replace("text", F.lit(m), F.lit(""))))
    kinds = lines.filter("line < 40").groupBy("file").agg((marks("\t") > marks(",")).alias("tab"))
    parsed = lines.filter("text <> ''").join(kinds, "file").withColumn("cells", F.when(F.col("tab"), F.split("text", "\t")).otherwise(comma_cells(F.col("text"))))
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    words = F.size(F.filter("cells", lambda c: c.rlike("[A-Za-z]") & ~c.rlike(r"^\s*[$(]?[0-9]")))
    share = words / F.size("cells")
    score = F.when(filled < 2, 0.3).when(share >= 0.99, 1.0).when(share >= 0.6, 0.8).otherwise(0.5)
    best = parsed.filter(F.col("line") < head).groupBy("file").agg(F.max(F.struct(score.alias("s"), (-F.col("line")).alias("l"), "cells")).alias("m")).select("file", (-F.col("m.l")).alias("at"), F.col("m.s").alias("confidence"), F.col("m.cells").alias("header"))
    return parsed.join(best, "file").filter(F.col("line") > F.col("at")).select("file", "line", "cells", "header", "confidence")


def _clean_names(raw: DataFrame) -> DataFrame:
    return raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])


def import_purchase_headers(raw: DataFrame) -> DataFrame:
    """Receipt headers from an export's text columns: money and day-first dates read, tax and refund derived."""
    df = _clean_names(raw)
    total, sub = parse_money(F.col("total")).cast(MONEY), parse_money(F.col("subtotal")).cast(MONEY)
    return df.select(
        F.trim("transaction_number").alias("number"), parse_date_multi(F.col("sales_date")).alias("sales_date"), F.trim("job_name").alias("job_name"),
        sub.alias("subtotal"), total.alias("total"), (total - sub).cast(MONEY).alias("tax"), (total < 0).alias("is_refund"),
    )


def import_purchase_lines(lines: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines numbered per receipt by ``line_order``, and headers with stubs for receipts that only lines name.

    ``scan_delimited`` numbers the lines it reads; without such a column a re-run could
    number them otherwise. A receipt's new lines replace its earlier ones when written with dynamic partition overwrite by receipt.
    """
    df = _clean_names(lines)
    if "line_order" not in df.columns:
        raise ValueError("the lines need a column line_order")
    order = Window.partitionBy("number").orderBy("line_order")
    read = df.select(F.trim("transaction_number").alias("number"), "line_order", F.nullif(F.trim("sku_number"), F.lit("")).alias("sku"), F.trim("product_name").alias("product_name"), parse_money(F.col("quantity")).cast("decimal(12,3)").alias("quantity"), parse_money(F.col("subtotal")).cast(MONEY).alias("subtotal"))
    numbered = read.withColumn("line_number", F.row_number().over(order))
    sums = numbered.groupBy("number").agg(F.sum("subtotal").cast(MONEY).alias("line_sum"))
    joined = headers.join(sums, "number", "full_outer").withColumn("is_stub", F.col("total").isNull() & F.col("line_sum").isNotNull())
    return numbered, joined


BOARD = "array<struct<id:string,name:string,group:struct<title:string>,column_values:array<struct<id:string,type:string,text:string,value:string>>,subitems:array<struct<id:string,name:string,column_values:array<struct<id:string,type:string,text:string,value:string>>>>>>"


def read_board_items(boards: DataFrame, *, json_col: str = "json") -> DataFrame:
    """(item_id, parent_id, name, group, column, type, text, value) of items and subitems in board JSON."""
    items = boards.select(F.explode(F.from_json(json_col, BOARD)).alias("i"))
    top = items.select(F.col("i.id").alias("item_id"), F.lit(None).cast("string").alias("parent_id"), F.col("i.name").alias("name"), F.col("i.group.title").alias("group"), F.col("i.column_values").alias("cols"))
    sub = items.select(F.col("i.id").alias("parent_id"), F.col("i.group.title").alias("group"), F.explode("i.subitems").alias("s")).select(F.col("s.id").alias("item_id"), "parent_id", F.col("s.name").alias("name"), "group", F.col("s.column_values").alias("cols"))
    return top.unionByName(sub).select("item_id", "parent_id", "name", "group", F.explode("cols").alias("c")).select("item_id", "parent_id", "name", "group", F.col("c.id").alias("column"), F.col("c.type").alias("type"), F.col("c.text").alias("text"), F.col("c.value").alias("value"))


#: Column titles to canonical fields, first match wins. Fixed values.
FIELD_PATTERNS = (
    ("status", r"(?i)status|statut|etat"), ("timeline", r"(?i)timeline|dates?$|period"), ("due_date", r"(?i)due|deadline|echeance"), ("duration", r"(?i)duration|days"),
    ("budget", r"(?i)budget|amount|value|montant"), ("people", r"(?i)people|owner|assigned|person"), ("supplier", r"(?i)supplier|vendor|fournisseur"),
)


def map_board_columns(cells: DataFrame) -> DataFrame:
    """One row per item with its canonical fields, typed: status, start, end, due_date, duration, budget, people, supplier."""
    field = F.lit(None).cast("string")
    for name, pattern in reversed(FIELD_PATTERNS):
        field = F.when(F.col("column").rlike(pattern), name).otherwise(field)
    named = cells.withColumn("field", field).filter("field is not null")
    wide = named.groupBy("item_id").pivot("field", [f for f, _ in FIELD_PATTERNS]).agg(F.min(F.struct("text", "value")))
    day = lambda c, k: F.try_to_date(F.get_json_object(c, k), "yyyy-MM-dd")
    return wide.select(
        "item_id", map_status_labels(F.col("status.text")).alias("status"), day("timeline.value", "$.from").alias("start_date"), day("timeline.value", "$.to").alias("end_date"), F.try_to_date("due_date.text", "yyyy-MM-dd").alias("due_date"),
        F.col("duration.text").try_cast("double").alias("duration"), parse_money(F.col("budget.text")).cast(MONEY).alias("budget"), F.col("people.text").alias("people"), F.col("supplier.text").alias("supplier"),
    )


def mirror_overlay(tasks: DataFrame, mirrors: DataFrame) -> DataFrame:
    """Tasks with the status and window that a linked item mirrors (task_ids, status, start_date, end_date): the mirror's value where it has one, of several the smallest."""
    each = mirrors.select(F.explode("task_ids").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("status", "start_date", "end_date")])
    one = each.groupBy("id").agg(*[F.min(f"_{c}").alias(f"_{c}") for c in ("status", "start_date", "end_date")])
    return tasks.join(one, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "start_date", "end_date")}).drop("_status", "_start_date", "_end_date")


ACCOUNTING = "struct<Id:string,DocNumber:string,TotalAmt:double,Balance:double,DueDate:string,TxnStatus:string,CustomerRef:struct<value:string,name:string>,PrivateNote:string>"


def map_accounting_docs(docs: DataFrame, projects: DataFrame, *, today: str) -> DataFrame:
    """Invoices and estimates in accounting JSON (kind, json) as rows with a status and the project whose code their note names."""
    d = docs.select("kind", F.from_json("json", ACCOUNTING).alias("d"))
    due = F.try_to_date("d.DueDate", "yyyy-MM-dd")
    invoice = F.when(F.col("d.Balance") == 0, "PAID").when(F.col("d.Balance") < F.col("d.TotalAmt"), "PARTIAL").when(due < F.lit(today).cast("date"), "OVERDUE").otherwise("SENT")
    estimate = F.when(F.col("d.TxnStatus") == "Accepted", "WON").when(F.col("d.TxnStatus") == "Rejected", "LOST").otherwise("PROPOSAL")
    code = F.upper(F.regexp_extract(F.coalesce("d.PrivateNote", F.lit("")), r"(?i)\b(J\d+)\b", 1))
    rows = d.select(F.col("d.Id").alias("id"), "kind", F.col("d.CustomerRef.value").alias("client_id"), F.col("d.TotalAmt").cast(MONEY).alias("amount"), due.alias("due_date"), F.when(F.col("kind") == "invoice", invoice).otherwise(estimate).alias("status"), code.alias("code"))
    return rows.join(projects.select(F.col("id").alias("project_id"), F.upper("code").alias("code")), "code", "left").drop("code")


CATEGORIES = (("contract", r"(?i)contract|agreement|contrat"), ("invoice", r"(?i)invoice|facture|billing"), ("photo", r"(?i)photo|picture"), ("plan", r"(?i)plan|drawing"))


def category_of(path: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def document_catalog(spark: SparkSession, path: str, *, root_depth: int = 0) -> DataFrame:
    """Files under a path without reading them: name, folder, depth, size, modified time, category and project bucket (the first folder)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    root = path.rstrip("/").split("/")[-1]
    parts = F.split(F.expr(f"substr(path, instr(path, '/{root}/') + {len(root) + 2})"), "/")
    return files.select("path", F.element_at(parts, -1).alias("name"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.size(parts).alias("depth"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), category_of(F.col("path")).alias("category"), F.when(F.size(parts) > root_depth + 1, F.get(parts, root_depth)).alias("bucket"))


_extractors: dict[str, Callable[[bytes], tuple[str, str]]] = {
    "text/plain": lambda b: (b.decode("utf-8", "replace"), "plain"),
    "text/csv": lambda b: (b.decode("utf-8-sig", "replace"), "csv"),
    "application/json": lambda b: (b.decode("utf-8", "replace"), "json"),
}


def register_extractor(mime_type: str, extractor: Callable[[bytes], tuple[str, str]]) -> None:
    """Add bytes -> (text, method) for a type; ``extract_corpus_text`` ships what is registered when it is called."""
    _extractors[mime_type] = extractor


def extract_corpus_text(files: DataFrame, *, most_bytes: int = 10 << 20) -> DataFrame:
    """(id, text, method) of files (id, mime_type, is_trashed, bytes, content); what is skipped says why.

    Skips are columns, so content that is not wanted never reaches Python.
    """
    table = dict(_extractors)
    skip = F.when(F.col("is_trashed"), "skipped-trashed").when(~F.coalesce(F.col("mime_type").isin(*table), F.lit(False)), "skipped-mime").when(F.col("bytes") > most_bytes, "skipped-size")
    marked = files.withColumn("skip", skip)

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, mime, content in zip(frame["id"], frame["mime_type"], frame["content"]):
                try:
                    rows.append((i, *table[mime](bytes(content))))
                except Exception as error:  # a broken file is a result, not the end of the job
                    rows.append((i, None, f"failed-{type(error).__name__}"))
            yield pd.DataFrame(rows, columns=["id", "text", "method"])

    key = files.schema["id"].dataType.simpleString()
    done = marked.filter("skip is null").select("id", "mime_type", "content").mapInPandas(extract, f"id {key}, text string, method string")
    return done.unionByName(marked.filter("skip is not null").select("id", F.lit(None).cast("string").alias("text"), F.col("skip").alias("method")))


def document_regions(parses: DataFrame, spans: DataFrame) -> DataFrame:
    """Citeable regions of each document's latest successful parse (parses: document_id, parse_id, created_at, ok; spans: parse_id, kind, locator, preview, confidence)."""
    latest = parses.filter("ok").groupBy("document_id").agg(F.max(F.struct("created_at", "parse_id")).alias("m")).select("document_id", F.col("m.parse_id").alias("parse_id"))
    return latest.join(spans, "parse_id").select("document_id", "parse_id", "kind", "locator", "preview", "confidence")


def import_scope_sheet(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages (one per project and division but 01; the first trade) and items (included unless N) of scope rows."""
    from ..functions.money import canonical_division

    clean = rows.withColumns({"division_code": canonical_division(F.col("csi_div_code")), "included": F.upper(F.coalesce(F.trim("included"), F.lit("Y"))) != "N"})
    packages = clean.filter("division_code <> '01'").groupBy("project_id", "division_code").agg(F.min(F.struct("item_id", "trade")).alias("m"), F.count(F.lit(1)).alias("items")).select("project_id", "division_code", F.col("m.trade").alias("trade"), "items")
    return packages, clean.select("project_id", "item_id", "division_code", "trade", "description", "included")


def import_template_tasks(rows: DataFrame, stored: DataFrame, *, phases: tuple[str, ...]) -> DataFrame:
    """Template tasks by (phase, ordinal) with their sub-task list split, merged over stored ones, in phase order."""
    subs = F.filter(F.transform(F.split(F.coalesce("subtasks", F.lit("")), r"[;\n]"), lambda s: F.trim(s)), lambda s: s != "")
    fresh = rows.select("phase", "ordinal", F.col("title").alias("new_title"), subs.alias("new_subs"))
    merged = stored.join(fresh, ["phase", "ordinal"], "full_outer").select("phase", "ordinal", F.coalesce("new_title", "title").alias("title"), F.coalesce("new_subs", "subtask_list").alias("subtask_list"))
    rank = F.lit(len(phases))
    for i, p in enumerate(phases):
        rank = F.when(F.col("phase") == p, i).otherwise(rank)
    return merged.withColumn("phase_rank", rank).orderBy("phase_rank", "ordinal")


def table_preview(df: DataFrame, *, n: int = 20, order: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows (in the given order), each with the table's full count."""
    first = (df.orderBy(*order) if order else df).limit(n)
    return first.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total_rows"))))


FAST_MIMES = ("text/csv", "text/plain", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")


def parse_priority(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Backfill order by additive score: fast type 100, telling name 40, telling folder 15, linked 5, active project 20."""
    active = projects.filter("status = 'ACTIVE'").select(F.col("id").alias("project_id"), F.lit(20).alias("_active"))
    telling = r"(?i)quote|invoice|contract|budget|cost"
    points = F.when(F.col("mime_type").isin(*FAST_MIMES), 100).otherwise(0) + F.when(F.col("name").rlike(telling), 40).otherwise(0) + F.when(F.col("folder_path").rlike(telling), 15).otherwise(0) + F.when(F.col("project_id").isNotNull(), 5).otherwise(0)
    return documents.filter(~F.col("is_trashed")).join(active, "project_id", "left").select("id", (points + F.coalesce("_active", F.lit(0))).alias("score")).orderBy(F.desc("score"), "id")


def export_work_log(entries: DataFrame, path: str) -> None:
    """Entries as CSV, one folder per project with a folder-safe name, sorted by date and name inside each file."""
    safe = F.trim(F.regexp_replace("project_name", r"[^A-Za-z0-9 _.-]", "_"))
    entries.withColumn("project", safe).drop("project_name").repartition("project").sortWithinPartitions("project", "work_date", "name").write.partitionBy("project").mode("overwrite").option("header", "true").csv(path)


def project_bundles(documents: DataFrame, records: DataFrame, *, clip: int = 2000) -> DataFrame:
    """One nested row per project: its documents with their records and clipped text."""
    own = records.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("record_kind", "direction", "amount"))).alias("records"))
    docs = documents.filter(~F.col("is_trashed")).join(own, documents["id"] == own["document_id"], "left")
    entry = F.struct(F.col("id"), F.col("name"), F.substring("body", 1, clip).alias("text"), F.coalesce("records", F.array().cast("array<struct<record_kind:string,direction:string,amount:decimal(14,2)>>")).alias("records"))
    return docs.groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("documents"))


def export_project_bundles(documents: DataFrame, records: DataFrame, path: str, *, clip: int = 2000) -> None:
    project_bundles(documents, records, clip=clip).write.mode("overwrite").json(path)
