"""License scans: sparse TF-IDF cosine to templates, then directory inheritance.

A unit is a sentence or line of a file. Units are compared with licence templates
by TF-IDF cosine; document frequencies of the templates' words count all files,
and any other word weighs as much as one that occurs in no file. A file's licence is that of
its best unit over the threshold. A file most of whose units are licence units
(or whose name says so) is a licence file, and sets the licence of its
directory. A file without a licence of its own takes that of its nearest
ancestor directory that has one, by joins on paths.

A unit over the threshold must contain one of a few anchor words: what is left of
a template's weight without them is less than the threshold. Only units with an
anchor are weighed, which changes no result.

Everything is a DataFrame expression. Defined results: null or empty texts have
no licence of their own; a null path has no directory and inherits nothing; ties
go to the template whose name comes last; repeated rows give repeated results;
very long texts are split into units whole; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Header sentences of common licences; a parameter.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Redistribution and use are permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
}
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
THRESHOLD = 0.8
MOST_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", text.lower())


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _words(text: Column) -> Column:
    return F.filter(F.split(_low(text), "[^a-z0-9]+"), lambda x: x != "")


def _units(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])[ \t]+|\n")


def document_path(id_col: str = "doc_id", source: str = "source", lang: str = "lang", per_dir: int = 100) -> Column:
    """A path for rows of ``documents``: source / language / shelf of ids / id."""
    shelf = F.floor(F.col(id_col) / per_dir).cast("string")
    return F.concat_ws("/", F.coalesce(source, F.lit("_")), F.coalesce(lang, F.lit("_")), F.coalesce(shelf, F.lit("_")), F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("_")), F.lit(".txt")))


def _weights(docs: DataFrame, templates: Mapping[str, str]) -> tuple[dict[str, float], float]:
    """idf of every template word over all files, and that of a word in no file. One row per template word reaches the driver."""
    vocabulary = sorted({w for t in templates.values() for w in template_words(t)})
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(F.split(_low(F.col("text")), "[^a-z0-9]+"), known)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    seen = {r["word"]: r["df"] for r in found.collect()}
    n = docs.count()
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}
    return idf, math.log(n + 1) + 1


def _vectors(idf: Mapping[str, float], templates: Mapping[str, str]) -> dict[str, dict[str, float]]:
    out = {}
    for name, text in templates.items():
        raw = {w: tf * idf[w] for w, tf in Counter(template_words(text)).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[name] = {w: x / norm for w, x in raw.items()}
    return out


def anchors(vectors: Mapping[str, Mapping[str, float]], threshold: float) -> list[str]:
    """Words without which no unit reaches the threshold: each template's heaviest, until the rest has a norm under it."""
    out: set[str] = set()
    for vector in vectors.values():
        rest = sum(x * x for w, x in vector.items() if w not in out)
        for w, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
            if rest < threshold * threshold:
                break
            if w not in out:
                out.add(w)
                rest -= x * x
    return sorted(out)


def own_licenses(docs: DataFrame, *, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, mark, units, license_units, license, cosine) of the files (id, mark, text) with a unit over the threshold; ``mark`` tells texts apart."""
    idf, other = _weights(docs, templates)
    vectors = _vectors(idf, templates)
    pattern = "(?<![a-z0-9])(" + "|".join(anchors(vectors, threshold)) + ")(?![a-z0-9])"
    some = docs.filter(_low(F.col("text")).rlike(pattern)).select("id", "mark", _units(F.col("text")).alias("parts"))
    counted = some.select("id", "mark", F.size(F.filter("parts", lambda x: x.rlike("[^ \t\r]"))).alias("units"), F.posexplode("parts").alias("unit", "part"))
    units = counted.filter(_low(F.col("part")).rlike(pattern))
    key = ["id", "mark", "units", "unit"]
    words = units.select(*key, F.explode(_words(F.col("part"))).alias("word")).groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    weighed = words.withColumn("x", F.col("tf") * F.coalesce(weight[F.col("word")], F.lit(other)))
    dots = [F.sum(F.col("x") * F.coalesce(F.create_map(*[F.lit(v) for pair in vector.items() for v in pair])[F.col("word")], F.lit(0.0))).alias(f"dot{i}") for i, vector in enumerate(vectors.values())]
    scored = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    best = F.array_max(F.array(*[F.struct((F.col(f"dot{i}") / F.col("norm")).alias("cosine"), F.lit(name).alias("license")) for i, name in enumerate(vectors)]))
    over = scored.withColumn("best", best).filter(F.col("best.cosine") >= threshold)
    return over.groupBy("id", "mark", "units").agg(F.count(F.lit(1)).alias("license_units"), F.max("best").alias("best")).select("id", "mark", "units", "license_units", F.col("best.license").alias("license"), F.col("best.cosine").alias("cosine"))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, path, license, cosine (own licences), origin (own, inherited or none) and from_dir."""
    scratch = Scratch(docs.sparkSession)
    named = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), (path if path is not None else document_path(id_col)).alias("path"))
    marked = named.withColumn("mark", F.xxhash64("text"))
    found = scratch.keep(own_licenses(marked.select("id", "mark", "text"), templates=templates, threshold=threshold), "own")
    held = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    narrow = marked.select("id", "mark", "path").join(held.withColumnsRenamed({"id": "oid", "mark": "omark"}), F.col("id").eqNullSafe(F.col("oid")) & (F.col("mark") == F.col("omark")), "left").drop("oid", "omark")
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    base = F.regexp_extract("path", "([^/]*)$", 1)
    files = scratch.keep(narrow.withColumns({"dir": directory, "is_license_file": F.col("license").isNotNull() & (base.rlike(LICENSE_NAMES) | (F.col("license_units") * 2 >= F.col("units")))}), "files")
    # Directories first: the joins below have one row per directory and ancestor, whatever the files in them.
    set_by = files.filter("is_license_file and dir is not null").groupBy("dir").agg(F.max(F.struct("cosine", "license")).alias("best")).select(F.col("dir").alias("from_dir"), F.col("best.license").alias("dir_license"))
    parts = F.split("dir", "/")
    lines = files.filter("dir is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from_dir")))).alias("a"))
    nearest = lines.select("dir", "a.depth", "a.from_dir").join(set_by, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_license")).alias("n"))
    nearest = scratch.keep(nearest.select(F.col("dir").alias("ndir"), "n.from_dir", "n.dir_license"), "nearest")
    near = F.broadcast(nearest) if nearest.count() <= MOST_BROADCAST else nearest
    joined = files.join(near, F.col("dir") == F.col("ndir"), "left")
    own = F.col("license").isNotNull()
    return joined.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "dir_license").alias("license"), F.round("cosine", 6).alias("cosine"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~own, F.col("from_dir")).alias("from_dir"),
    )
