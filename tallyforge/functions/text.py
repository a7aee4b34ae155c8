"""Text expressions: names, streets, tokens, numbers in text. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import STOPWORDS, STREET_WORDS

#: Accented letters of the documented alphabet and what they fold to; Spark has no decomposition.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, FOLDED)


def normalize_name(text: Column) -> Column:
    """Accents off, lower case, punctuation to spaces, spaces collapsed; other non-ASCII characters go."""
    ascii_only = F.regexp_replace(fold_accents(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9_\s]", " "), r"\s+", " "))


def normalize_job(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def phrase_in(needle: Column, hay: Column) -> Column:
    """Whether a normalised phrase occurs on whole-token boundaries."""
    return (needle != "") & (hay != "") & F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def street_tokens(text: Column) -> Column:
    """Tokens without numbers and street words; saint becomes st."""
    tokens = F.filter(F.split(normalize_job(text), " "), lambda t: (t != "") & ~t.isin(*STREET_WORDS) & ~t.rlike("[0-9]"))
    return F.transform(tokens, lambda t: F.when(t == "saint", "st").otherwise(t))


def street_signature(text: Column) -> Column:
    return F.array_join(street_tokens(text), "")


def prefix_candidates(text: Column) -> Column:
    """The first street token, and the first two joined, of at least three characters."""
    tokens = street_tokens(text)
    one, two = F.get(tokens, 0), F.concat(F.get(tokens, 0), F.get(tokens, 1))
    return F.array_distinct(F.filter(F.array_compact(F.array(one, two)), lambda t: F.length(t) >= 3))


def civic_numbers(text: Column) -> Column:
    """One or two leading numbers of 3 to 5 digits."""
    pattern = r"^\s*(\d{3,5})(?:[-\s]+(\d{3,5}))?\b"
    found = F.array(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 2))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def keyword_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two characters or more that are no stopwords."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS)))


def keyword_score(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of distinct query terms that a text has, 0 without terms."""
    n = F.size(query_tokens)
    return F.when((n > 0) & (F.size(text_tokens) > 0), F.size(F.array_intersect(query_tokens, text_tokens)) / n).otherwise(0.0)


def document_numbers(text: Column) -> Column:
    """Every value a text's numbers can stand for (English and French reading, spaced thousands joined, k and m suffixes), as decimals to two places."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\u00A0\\u202F\\u2009]", " ")
    joined = low
    for _ in range(3):  # each pass joins every second group: three reach a number of eight groups
        joined = F.regexp_replace(joined, r"(\d) (\d{3})(?=\D|$)", "$1$2")
    pattern = r"\d[\d.,]*\d|\d"
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), F.regexp_extract_all(joined, F.lit(pattern), F.lit(0))))
    plain = F.flatten(F.transform(tokens, _readings))
    suffixed = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9.,])(\d[\d.,]*\s?[km])(?![a-z])"), F.lit(1)), _suffixed))
    return F.array_distinct(F.array_compact(F.concat(plain, suffixed)))


def _decimal(text: Column) -> Column:
    return F.round(text.try_cast("decimal(30,8)"), 2).cast("decimal(24,2)")


def _readings(token: Column) -> Column:
    comma, dot = F.contains(token, F.lit(",")), F.contains(token, F.lit("."))
    last_comma = F.length(token) - F.instr(F.reverse(token), ",")
    last_dot = F.length(token) - F.instr(F.reverse(token), ".")
    no_comma = F.regexp_replace(token, ",", "")
    european = F.replace(F.regexp_replace(token, "[.]", ""), F.lit(","), F.lit("."))
    french = F.when(token.rlike(r"^[^,]*,\d{1,2}$"), F.replace(token, F.lit(","), F.lit(".")))
    one = F.when(comma & dot, F.when(last_comma > last_dot, european).otherwise(no_comma)).when(comma, no_comma).otherwise(token)
    two = F.when(comma & ~dot, french)
    return F.array(_decimal(one), _decimal(two))


def _suffixed(token: Column) -> Column:
    scale = F.when(token.endswith("k"), F.lit(1000)).otherwise(F.lit(1_000_000))
    base = F.regexp_replace(F.regexp_replace(token, r"\s?[km]$", ""), "[.,]+$", "")
    return F.transform(_readings(base), lambda x: F.round(x * scale, 2).cast("decimal(24,2)"))


def amount_in_text(amount: Column, numbers: Column) -> Column:
    """Whether an amount's magnitude is among a text's numbers; false for null."""
    return F.coalesce(F.array_contains(numbers, F.abs(F.round(amount, 2)).cast("decimal(24,2)")), F.lit(False))


def dollar_amounts(text: Column) -> Column:
    """Amounts written with a dollar sign, as decimals."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\$\s?([0-9][0-9,]*(?:\.[0-9]{1,2})?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(18,2)"))


def comma_cells(line: Column) -> Column:
    """Cells of one comma-separated line, without the quotes around them; a comma inside double quotes does not separate.

    A comma separates where an even number of quotes follows it. Parts between quotes
    are looked at once each, from the last, so the work is linear in the line; a line break, which a
    line cannot hold, stands for the commas that separate.
    """
    back = F.reverse(F.split(line, '"'))
    marked = F.reverse(F.transform(back, lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", "\n")).otherwise(p)))
    parts = F.when(F.contains(line, F.lit('"')), F.split(F.array_join(marked, '"'), "\n")).otherwise(F.split(line, "[,\n]"))
    return F.transform(parts, lambda c: F.when(F.contains(c, F.lit('"')), F.regexp_replace(F.trim(c), r'^"|"$', "")).otherwise(F.trim(c)))
