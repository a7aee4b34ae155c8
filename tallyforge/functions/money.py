"""Money, dates, clocks and names of things, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .text import fold_accents

MONEY = "decimal(18,2)"


def parse_money(cell: Column) -> Column:
    """Money as written in exports: $, any spaces, (x) and trailing - as negative, dot or comma as decimal mark."""
    s = F.trim(cell)
    bracket = s.startswith("(") & s.endswith(")")
    s = F.when(bracket, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    s = F.regexp_replace(s, "[\\s\\u00A0\\u202F\\u2009$]", "")
    tail = s.endswith("-")
    s = F.regexp_replace(s, "-$", "")
    lead = s.startswith("-")
    s = F.regexp_replace(s, "^-", "")
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    last = lambda mark: F.length(s) - F.instr(F.reverse(s), mark)
    both = F.when(last(",") > last("."), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    one = F.when(s.rlike(r"^\d+(,\d+)*,\d{2}$") & s.rlike(r"^\d+,\d{2}$"), F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    plain = F.when(comma & dot, both).when(comma, one).otherwise(s)
    value = F.when(plain.rlike(r"^(\d+\.?\d*|\.\d+)$"), plain.try_cast(MONEY))
    return F.when(bracket | tail | lead, -value).otherwise(value)


def parse_grid_money(cell: Column) -> Column:
    """Money in English sheets: $ and thousands commas, (x) negative; null if it is no number."""
    s = F.trim(cell)
    negative = s.startswith("(") & s.endswith(")")
    s = F.regexp_replace(F.regexp_replace(s, r"^[()]+|[()]+$", ""), "[\\s\\u00A0\\u202F$,]", "")
    value = F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s.try_cast(MONEY))
    # Most cells of a sheet are empty.
    return F.when(cell != "", F.when(negative, -value).otherwise(value))


def parse_date_multi(cell: Column, formats: Sequence[str] = ("dd/MM/yyyy", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy")) -> Column:
    """The first of the formats that reads the cell."""
    return F.coalesce(*[F.try_to_date(F.trim(cell), f) for f in formats])


def parse_clock(cell: Column) -> Column:
    """Clock times such as 7:30 AM, 4pm, 16h00, 7:30 or 0730 as HH:MM, else null."""
    s = F.lower(F.trim(cell))
    hm_ap, h_ap, hm, compact = r"^(\d{1,2})[:h](\d{2})\s*([ap])\.?m?\.?$", r"^(\d{1,2})\s*([ap])\.?m?\.?$", r"^(\d{1,2})[:h](\d{2})$", r"^(\d{3,4})$"
    num = lambda pattern, k: F.regexp_extract(s, pattern, k).try_cast("int")

    def twelve(h: Column, half: Column) -> Column:
        return F.when((h < 1) | (h > 12), None).when(half == "a", F.when(h == 12, 0).otherwise(h)).otherwise(F.when(h == 12, h).otherwise(h + 12))

    def text(h: Column, m: Column) -> Column:
        return F.when((h <= 23) & (m <= 59), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0")))

    digits = F.regexp_extract(s, compact, 1)
    return (
        F.when(s.rlike(hm_ap), text(twelve(num(hm_ap, 1), F.regexp_extract(s, hm_ap, 3)), num(hm_ap, 2))).when(s.rlike(h_ap), text(twelve(num(h_ap, 1), F.regexp_extract(s, h_ap, 2)), F.lit(0)))
        .when(s.rlike(hm), text(num(hm, 1), num(hm, 2))).when(s.rlike(compact), text(F.substring(digits, F.lit(1), F.length(digits) - 2).try_cast("int"), F.substring(digits, -2, 2).try_cast("int")))
    )


def clock_minutes(clock: Column) -> Column:
    return F.substring(clock, 1, 2).try_cast("int") * 60 + F.substring(clock, 4, 2).try_cast("int")


def worked_hours(arrived: Column, left: Column, lunch: Column) -> Column:
    """(left - arrived) - lunch in hours; null when overnight or negative."""
    span = clock_minutes(left) - clock_minutes(arrived)
    hours = (span.cast("decimal(10,4)") / 60).cast("decimal(10,4)") - F.coalesce(lunch, F.lit(0)).cast("decimal(10,4)")
    return F.when((span >= 0) & (hours >= 0), F.round(hours, 2).cast("decimal(6,2)"))


def canonical_division(code: Column) -> Column:
    """Division code with its spellings folded; unknown codes pass through."""
    s = F.trim(code)
    squeezed = F.regexp_replace(s, "[^0-9]", "")
    return F.when(squeezed.isin("10", "11", "12", "1012"), "10-12").when(squeezed.isin("31", "32", "3132"), "31-32").when(s.rlike(r"^\d$"), F.lpad(s, 2, "0")).otherwise(s)


def classify_division(hint: Column, text: Column) -> Column:
    """Division of a line: code in the hint, words in the hint, words in the text, else 99."""
    fold = lambda c: F.lower(fold_accents(F.coalesce(c, F.lit(""))))
    pattern = lambda words: r"\b(" + "|".join(words) + r")s?\b"

    def worded(source: Column, rest: Column) -> Column:
        out = F.lit(R.UNCLASSIFIED[0])
        for d, _, words in reversed(R.DIVISIONS):
            out = F.when(source.rlike(pattern(words)), d).otherwise(out)
        # Most texts have no word of any division: one search tells.
        return F.when(source.rlike(pattern([w for _, _, words in R.DIVISIONS for w in words])), out).otherwise(rest)

    def division(x: Column) -> Column:
        code = canonical_division(F.regexp_extract(x["hint"], r"^\s*(?:div\.?\s*)?(\d{1,2}(?:-\d{2})?)", 1))
        coded = F.when((x["hint"] != "") & code.isin(*[d for d, _, _ in R.DIVISIONS]), code)
        return F.coalesce(coded, worded(x["hint"], worded(x["text"], F.lit(R.UNCLASSIFIED[0]))))

    # As a function of an array's one element: written out in a row's code, so many searches make a method that the JVM does not compile.
    return F.get(F.transform(F.array(F.struct(fold(hint).alias("hint"), fold(text).alias("text"))), division), 0)


def division_name(code: Column) -> Column:
    out = F.lit(R.UNCLASSIFIED[1])
    for d, name, _ in R.DIVISIONS:
        out = F.when(code == d, name).otherwise(out)
    return out


def classify_sheet(name: Column, text: Column) -> Column:
    """Layout of a sheet from its name and first eight lines: extras, job cost, order quantities, quote or unknown."""
    head = F.substring_index(F.coalesce(text, F.lit("")), "\n", 8)
    blob = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" || "), head))
    has = lambda x, marks: reduce(or_, [F.contains(x, F.lit(m)) for m in marks])
    layout = lambda x: F.when(has(x, R.EXTRAS_MARKERS), "extras").when(has(x, R.JOBCOST_MARKERS), "job_cost").when(has(x, R.ORDER_MARKERS), "order_quantities").when(has(x, R.QUOTE_MARKERS), "quote").otherwise("unknown")
    return F.get(F.transform(F.array(blob), layout), 0)


def classify_extras_status(cell: Column) -> Column:
    """accepted, proposed, unknown, or null for rows to skip (rejected)."""
    s = fold_accents(F.trim(F.coalesce(cell, F.lit(""))))
    return F.when(s == "", "unknown").when(s.rlike(R.EXTRAS_REJECTED), None).when(s.rlike(R.EXTRAS_ACCEPTED), "accepted").when(s.rlike(R.EXTRAS_PROPOSED), "proposed").otherwise("unknown")


def is_tax_line(amount_type: Column, description: Column) -> Column:
    return F.coalesce(F.lower(amount_type) == "tax", F.lit(False)) | F.coalesce(description.rlike(R.TAX_TERM), F.lit(False))


def is_rollup(name: Column, text: Column) -> Column:
    return F.coalesce(name.rlike(R.ROLLUP_NAME), F.lit(False)) | F.coalesce(F.substring(text, 1, 8000).rlike(R.PROJECTION_CONTENT), F.lit(False))


def doc_unit(name: Column) -> Column:
    """Unit in a file name: three or four leading digits; none for a range; exterior."""
    lead = F.regexp_extract(name, r"^[\s_]*(\d{3,4})\b", 1)
    return F.when(name.rlike(r"\b\d{3,4}-\d{3,4}\b"), None).when(lead != "", lead).when(name.rlike(r"(?i)\bexterior\b"), "exterior")


def doc_status(name: Column) -> Column:
    up = F.upper(F.coalesce(name, F.lit("")))
    return F.when(up.rlike("NOT STARTED|NOT ACCEPTED"), "proposed").when(F.contains(up, F.lit("ACCEPTED")), "accepted").otherwise("unknown")


def doc_currency(text: Column) -> Column:
    head = F.substring_index(F.coalesce(text, F.lit("")), "\n", 20)
    return F.when(F.contains(head, F.lit("USD")), "USD").otherwise("CAD")


def bid_status_from_name(name: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?i)(?:^|[_\W])(pending|recommended|selected|rejected)(?:$|[_\W])", 1))
    return F.when(found == "", "pending").otherwise(found)


def map_status_labels(label: Column, default: str = "TODO") -> Column:
    low = F.lower(F.trim(label))
    out = F.lit(default)
    for name, status in R.STATUS_LABELS.items():
        out = F.when(low == name, status).otherwise(out)
    return out


def money_short(value: Column) -> Column:
    """$402, $52k, $1.2M."""
    x = F.coalesce(value, F.lit(0)).cast("decimal(24,2)")
    a = F.abs(x)
    short = lambda scale, mark: F.concat(F.regexp_replace(F.format_string("%.1f", F.round((a / scale).cast("decimal(24,8)"), 1).cast("double")), r"\.0$", ""), F.lit(mark))
    body = F.when(a >= 1_000_000, short(1_000_000, "M")).when(a >= 1000, short(1000, "k")).otherwise(F.round(a, 0).cast("decimal(24,0)").cast("string"))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), body)
