"""Quality rules: counts over whole texts, then tokeniser fertility bands.

Base counts come from the words of each text (see ``words``). The method's
verdict measures how public vocabularies (pieces and bytes) cope with the text:
code points per token, share of byte-fallback tokens and entropy of the token
distribution, held against rejection bands per language or, where a language has
too few texts, per script. The bands are fences around the quartiles of all texts
of the group that pass the base rules: REACH interquartile ranges to either side.
Tokens are those of each word by itself, so that a distinct word of a block is
tokenised once; this equals running text for vocabularies whose pieces do not
cross white space.

Defined results: a null text counts as empty; a text without tokens has null
ratios and fails the base rules; a null language is judged by script, a group with
too few texts by the widest band; texts under LEAST_TOKENS tokens are too short to
judge and are kept if the base rules pass; very long texts count whole; repeated
rows give repeated results, null ids included; an empty table gives an empty one;
input columns beyond the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .words import SHINGLE, blocks, shingles, words

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")

#: Texts with fewer tokens are not judged by the bands.
LEAST_TOKENS = 50
#: Texts that a language or script needs for bands of its own.
LEAST_TEXTS = 100
#: Interquartile ranges from a quartile to its fence, and the least such range as a share of the upper quartile.
REACH, LEAST_RANGE = 3.0, 0.02
#: Byte-fallback share that no band rejects.
FREE_BYTE_SHARE = 0.1
#: The widest band (code points per token from, to; byte share; entropy), for groups too small to have one.
WIDEST = (0.25, 12.0, 0.9, 2.0)
#: Rows of bands broadcast at most.
MOST_BROADCAST = 100_000

#: First and last lead byte (UTF-8) of the scripts told apart; the script of a text is that of most of its letters.
SCRIPTS = {"Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)], "Cyrillic": [(0xD0, 0xD3)], "Han": [(0xE3, 0xE9)]}

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_loaded: dict[str, tuple] = {}


def load_vocabulary(path: str) -> tuple:
    """(encode a list of words to lists of ids, byte-fallback flag per id); kept for the life of the worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = (lambda ws: model.encode(ws, num_threads=1)), np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            encoder = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            partial = np.zeros(max(ranks.values()) + 1, dtype=bool)
            for piece, rank in ranks.items():
                try:
                    piece.decode()
                except UnicodeDecodeError:
                    partial[rank] = True
            _loaded[path] = (lambda ws: [encoder.encode_ordinary(" " + w) for w in ws]), partial
    return _loaded[path]


def _per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def base_counts(column: pa.Array) -> tuple[dict[str, np.ndarray], object]:
    """The contract's counts for a block of texts, and its words."""
    w = words(column)
    n = len(column)
    count = np.diff(w.first)
    inside = np.zeros(len(w.data) + 1, dtype=np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    dup_lines = np.zeros(n, dtype=np.int64)
    whole = w.data.tobytes()
    for i, (a, b) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist())):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        dup_lines[i] = len(lines) - len(set(lines))
    # Repeats are told by the words as they stand: their hashes fold case.
    hashes, at = shingles(w._replace(code=_cased(w)))
    windows = np.where(count >= SHINGLE, np.diff(at), 0)
    covered = np.zeros(len(w.code) + 1, dtype=np.int64)
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    hit = hit[windows[doc[hit]] > 0]
    begin = w.first[doc[hit]] + hit - at[doc[hit]]
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + SHINGLE, -1)
    return {
        "n_words": count,
        "word_chars": _per_text(in_word & _LEAD[w.data], w.offsets),
        "n_symbols": _per_text(_SYMBOLS[w.data], w.offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _per_text(np.cumsum(covered[:-1]) > 0, w.first),
    }, w


def fertility(w, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and token entropy (bits) of each text of a block."""
    n = len(w.first) - 1
    if not len(w.code):
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
    encode, is_byte = load_vocabulary(vocabulary)
    # The hash folds case, tokens do not: tell words apart by their first bytes' case too.
    _, first, back = np.unique(_cased(w), return_index=True, return_inverse=True)
    whole = w.data.tobytes()
    pieces = encode([whole[a:b].decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[first].tolist())])
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    ids = np.fromiter((i for p in pieces for i in p), dtype=np.int64, count=int(sizes.sum()))
    per_word = sizes[back]
    n_tokens = _per_text(per_word, w.first)
    n_bytes = _per_text(np.add.reduceat(np.append(is_byte[ids], False).astype(np.int64), np.append(begins, len(ids)))[:-1][back] * (per_word > 0), w.first)
    at = np.cumsum(per_word) - per_word
    token = ids[np.repeat(begins[back] - at, per_word) + np.arange(int(per_word.sum()))]
    doc = np.repeat(np.arange(n), n_tokens)
    pair, times = np.unique(doc * len(is_byte) + token, return_counts=True)
    owner = pair // len(is_byte)
    share = times / n_tokens[owner]
    return n_tokens, n_bytes, np.bincount(owner, weights=-share * np.log2(share), minlength=n)


def _cased(w) -> np.ndarray:
    """Word hashes that tell capitals apart."""
    if not len(w.code):
        return w.code
    upper = ((w.data >= 65) & (w.data <= 90)).astype(np.uint64)
    place = (np.arange(len(w.data), dtype=np.uint64) - np.repeat(w.start, np.diff(np.append(w.start, len(w.data)))).astype(np.uint64)) if w.start[0] == 0 else None
    if place is None:
        place = np.zeros(len(w.data), dtype=np.uint64)
        place[w.start[0] :] = (np.arange(w.start[0], len(w.data)) - np.repeat(w.start, np.diff(np.append(w.start, len(w.data))))).astype(np.uint64)
    marks = upper * (place + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    return w.code + np.add.reduceat(marks ^ (marks >> np.uint64(29)), w.start)


def scripts_of(w) -> list[str]:
    """The script of each text of a block; "*" without a letter of any."""
    n = len(w.first) - 1
    counts = []
    for ranges in SCRIPTS.values():
        inside = np.zeros(256, dtype=bool)
        for a, b in ranges:
            inside[a : b + 1] = True
        counts.append(_per_text(inside[w.data], w.offsets) if len(w.data) else np.zeros(n, dtype=np.int64))
    most = np.argmax(counts, axis=0)
    return [name if some else "*" for name, some in zip(np.array(list(SCRIPTS))[most].tolist(), np.max(counts, axis=0).tolist())]


def measures(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, vocabularies: Sequence[str], least_words: int, most_repeat_percent: int) -> DataFrame:
    """Counts and fertility of every text, per vocabulary k in columns that end in k; a map over partitions."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                base, w = base_counts(block.column(1))
                failed = (base["n_words"] < least_words) | (100 * base["n_repeat_words"] > most_repeat_percent * base["n_words"])
                columns = [block.column(0), block.column(2), pa.array(scripts_of(w), pa.string()), *(pa.array(base[k], pa.int64()) for k in _BASE), pa.array(failed)]
                for vocabulary in vocabularies:
                    tokens, fallback, entropy = fertility(w, vocabulary)
                    none = tokens == 0
                    columns += [pa.array(tokens, pa.int64()), *(pa.array(x, pa.float64(), mask=none) for x in (base["word_chars"] / np.maximum(tokens, 1), fallback / np.maximum(tokens, 1), entropy))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    per = [f"{c}_{k}" for k in range(len(vocabularies)) for c in ("n_tokens", *MEASURES)]
    names = ["id", "lang", "script", *_BASE, "base_failed", *per]
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    types = [picked.schema["id"].dataType.simpleString(), "string", "string", *["long"] * len(_BASE), "boolean", *(t for _ in vocabularies for t in ("long", "double", "double", "double"))]
    return picked.mapInArrow(measure, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def bands(measured: DataFrame, group: str, n_vocabularies: int, least_texts: int) -> DataFrame:
    """(group, band): per vocabulary low and high code points per token, most byte share and least entropy, of groups with enough texts."""
    judged = measured.filter(~F.col("base_failed") & (F.col("n_tokens_0") >= LEAST_TOKENS) & F.col(group).isNotNull())
    quartiles = [F.percentile_approx(f"{m}_{k}", [0.25, 0.75], 10_000).alias(f"q_{m}_{k}") for k in range(n_vocabularies) for m in MEASURES]
    found = judged.groupBy(group).agg(F.count(F.lit(1)).alias("texts"), *quartiles).filter(F.col("texts") >= least_texts)
    at = lambda m, k, i: F.get(f"q_{m}_{k}", i)
    reach = lambda m, k: REACH * F.greatest(at(m, k, 1) - at(m, k, 0), LEAST_RANGE * at(m, k, 1))
    band = lambda k: F.struct(
        (at(MEASURES[0], k, 0) - reach(MEASURES[0], k)).alias("low"), (at(MEASURES[0], k, 1) + reach(MEASURES[0], k)).alias("high"),
        F.greatest(at(MEASURES[1], k, 1) + reach(MEASURES[1], k), F.lit(FREE_BYTE_SHARE)).alias("bytes"), (at(MEASURES[2], k, 0) - reach(MEASURES[2], k)).alias("entropy"),
    )
    return found.select(group, F.array(*[band(k) for k in range(n_vocabularies)]).alias(f"{group}_band"))


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabularies: Sequence[str] = tuple(f"{TOKENIZER_DIR}/{v}" for v in VOCABULARIES),
    least_words: int = 10,
    most_repeat_percent: int = 20,
    least_texts: int = LEAST_TEXTS,
) -> DataFrame:
    """One row per document: base counts, fertility measures, verdicts.

    ``base_failed``: n_words < least_words, or 100 * n_repeat_words > most_repeat_percent * n_words.
    ``kept``: not base_failed and within the band of the language, else of the script, for every vocabulary.
    Texts are read once; the narrow measures are written, and the bands come from sums of quantile sketches over them.
    """
    n = len(vocabularies)
    found = measures(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, vocabularies=vocabularies, least_words=least_words, most_repeat_percent=most_repeat_percent)
    scratch = Scratch(docs.sparkSession)
    measured = scratch.keep(found, "measures")
    for group in ("lang", "script"):
        own = scratch.keep(bands(measured, group, n, least_texts), f"bands-{group}")
        found = (found if group == "script" else measured).join(F.broadcast(own) if own.count() <= MOST_BROADCAST else own, group, "left")
    widest = F.struct(*[F.lit(x).alias(c) for x, c in zip(WIDEST, ("low", "high", "bytes", "entropy"))])
    band = F.coalesce("lang_band", "script_band", F.array(*[widest] * n))
    good = F.lit(True)
    for k in range(n):
        own = F.get(band, k)
        within = F.col(f"chars_per_token_{k}").between(own["low"], own["high"]) & (F.col(f"byte_share_{k}") <= own["bytes"]) & (F.col(f"token_entropy_{k}") >= own["entropy"])
        good = good & ((F.col(f"n_tokens_{k}") < LEAST_TOKENS) | F.coalesce(within, F.lit(False)))
    name = F.when(F.col("lang_band").isNotNull(), F.col("lang")).when(F.col("script_band").isNotNull(), F.col("script")).otherwise("*")
    per = [f"{c}_{k}" for k in range(n) for c in ("n_tokens", *MEASURES)]
    return found.select(F.col("id").alias(id_col), *_BASE, "base_failed", (~F.col("base_failed") & good).alias("kept"), name.alias("band"), *per)
