"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a partition, in the order of its rows, are one stream of tokens
(each document's ids, then id 0). Cuts may fall at the end of a document (free), at
the end of a sentence (SENTENCE), and, in sentences of over LONG tokens, every STEP
tokens (INSIDE). With f(p) the least cost of packing the stream up to cut p,

    f(p) = penalty(p) + EACH + min( min over p - 1024 <= q < p of f(q) + 1024 - (p - q),
                                    min over q = p - 2**k of f(q) ):

a sequence is padded to 1024 tokens, unless its length is a power of two. The first
minimum is that of f(q) + q in a window that slides with p, kept by a monotone
queue; the second looks at eleven places. EACH keeps the sequences from falling to
pieces. The optimum is exact within a block: documents are taken together until they
pass BLOCK_TOKENS, so a worker holds one block or one longer document.

Tokens: a text is parted where the vocabulary's pattern always parts it as well:
before a space (0x20) that a visible character follows, between an ASCII letter or
digit and one of ``.,;:!?``, and between a lone line break and a visible character.
Each distinct part is encoded once per worker (a bounded memory; parts are told apart
by 64-bit hashes).

No row is shuffled: a task reads its file splits and numbers its sequences under its
partition's number, so a task that runs again gives the same rows.

Defined results: a null or empty text has the one id 0; a null id is kept as null and
repeated rows are packed once each; very long texts are cut like others; ties go to
the earlier cut of the window and to the window before a power of two; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BLOCK_BYTES, blocks, raw, span_codes

#: A vocabulary, the same vocabulary as ranks, and the pattern that parts texts before its merges (fixed value).
TOKENIZER, RANKS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 1024
#: Costs, in tokens of padding: a cut at a sentence's end, a cut inside a sentence, a sequence.
SENTENCE, INSIDE, EACH = 2, 24, 4
#: Sentences of more tokens than LONG may be cut every STEP tokens.
LONG, STEP = 64, 32
BLOCK_TOKENS = 1 << 20
#: Parts that a worker remembers.
MOST_PARTS = 2_000_000

_loaded: dict[tuple[str, str], "Encoder"] = {}

#: Bytes after a space that do not show whether a visible character follows: blanks and first bytes of Unicode's blanks.
_UNSURE = np.zeros(256, dtype=bool)
_UNSURE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ALNUM, _MARKS, _VISIBLE = (np.zeros(256, dtype=bool) for _ in range(3))
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS[list(b".,;:!?")] = True
_VISIBLE[0x21:0x7F] = True


class Encoder:
    """Ids of texts under a byte-level vocabulary, through a memory of parts.

    Parts in Latin letters go by the vocabulary's rank file, which encodes short texts
    faster; other parts, whose letters libraries may class differently, by the
    tokenizer itself. Names of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.latin = tiktoken.Encoding("latin", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        names = sorted(self.model.get_vocab().items(), key=lambda x: x[1])
        size = names[-1][1] + 1
        self.breaks, self.stops, self.opens = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for name, i in names:  # the vocabulary writes a space as Ġ and a line break as Ċ
            self.breaks[i] = "Ċ" in name
            self.stops[i] = name.rstrip("\"')]Ġ")[-1:] in (".", "!", "?")
            self.opens[i] = name[0] in "ĠĊ"
        self.forget()

    def forget(self) -> None:
        self.codes = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, codes: np.ndarray, parts: list[bytes]) -> None:
        found = [self.latin.encode_ordinary(p.decode()) if max(p) < 0xCA else None for p in parts]
        other = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(other, self.model.encode_batch([parts[i].decode() for i in other], add_special_tokens=False)):
            found[i] = e.ids
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(size.sum()))
        at = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, at, codes)
        self.place = np.insert(self.place, at, np.arange(len(codes)) + len(self.first) - 1)
        self.first = np.append(self.first, self.first[-1] + np.cumsum(size))
        self.ids = np.append(self.ids, flat)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, 0 after each, and the len + 1 places where texts begin."""
        data, offsets = raw(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, dtype=np.uint32), np.arange(n + 1)
        cut = np.zeros(len(data), dtype=bool)
        shown = ~_UNSURE[data[1:]]
        cut[:-1] = (data[:-1] == 0x20) & shown
        # A space at the end of one text says nothing of the next.
        cut[offsets[1:-1][offsets[1:-1] > 0] - 1] = False
        cut[1:] |= _MARKS[data[1:]] & _ALNUM[data[:-1]]
        cut[2:] |= (data[1:-1] == 0x0A) & _VISIBLE[data[:-2]] & shown[1:]
        edges = offsets[:-1]
        cut[edges[edges < len(data)]] = True
        start = np.flatnonzero(cut)
        code = span_codes(data, start)
        known, inverse = np.unique(code, return_inverse=True)
        at = np.searchsorted(self.codes, known)
        new = np.flatnonzero(self.codes[np.minimum(at, len(self.codes) - 1)] != known) if len(self.codes) else np.arange(len(known))
        if len(new):
            if len(self.codes) + len(new) > MOST_PARTS:
                self.forget()
                new = np.arange(len(known))
            one = np.zeros(len(known), dtype=np.int64)
            one[inverse] = np.arange(len(code))
            end = np.append(start[1:], len(data))
            self._learn(known[new], [data[a:b].tobytes() for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist())])
            at = np.searchsorted(self.codes, known)
        place = self.place[at][inverse]
        size = self.first[place + 1] - self.first[place]
        row = np.searchsorted(offsets, start, side="right") - 1
        total = np.bincount(row, weights=size, minlength=n).astype(np.int64) + 1
        begin = np.append(0, np.cumsum(total))
        inner = np.cumsum(size) - size
        own = np.ones(begin[-1], dtype=bool)
        own[begin[1:] - 1] = False
        out = np.zeros(begin[-1], dtype=np.uint32)
        out[own] = self.ids[np.repeat(self.first[place] - inner, size) + np.arange(int(size.sum()))]
        return out, begin


def encoder(path: str, ranks: str) -> Encoder:
    if (path, ranks) not in _loaded:
        _loaded.clear()
        _loaded[path, ranks] = Encoder(path, ranks)
    return _loaded[path, ranks]


def cut_places(ids: np.ndarray, begin: np.ndarray, model: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, ascending from 0 to its length, and the penalty of each place."""
    ends = np.flatnonzero(model.breaks[ids] | (model.stops[ids] & np.append(model.opens[ids[1:]], True))) + 1
    docs = begin[1:]
    places = np.unique(np.concatenate([[0], ends, docs]))
    gap = np.diff(places)
    long = np.flatnonzero(gap > LONG)
    more = (gap[long] - 1) // STEP
    extra = np.repeat(places[long], more) + STEP * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
    cost = np.full(len(ids) + 1, INSIDE)
    cost[ends] = SENTENCE
    cost[docs] = 0
    cost[0] = 0
    places = np.unique(np.concatenate([places, extra])).astype(np.int64)
    return places, cost[places]


def choose_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places of least cost at which the sequences of a stream end, 0 included."""
    m = len(places)
    index = np.full(int(places[-1]) + 1, -1, dtype=np.int64)
    index[places] = np.arange(m)
    later, earlier = [], []
    for k in range(window.bit_length()):
        back = places - (1 << k)
        i = np.flatnonzero(back >= 0)
        j = index[back[i]]
        later.append(i[j >= 0])
        earlier.append(j[j >= 0])
    later = np.concatenate(later)
    order = np.argsort(later, kind="stable")
    exact = np.concatenate(earlier)[order].tolist()
    first = np.searchsorted(later[order], np.arange(m + 1)).tolist()
    at, extra = places.tolist(), (penalty + EACH).tolist()
    cost, came = [0] * m, [0] * m
    # Monotone queue of (cost + place, place, index), ascending; what precedes ``head`` has left the window.
    queue, head = [(0, 0, 0)], 0
    a = first[1]
    for i, p, more, b in zip(range(1, m), at[1:], extra[1:], first[2:]):
        least = p - window
        while queue[head][1] < least:
            head += 1
        best, _, source = queue[head]
        best -= least
        while a < b:
            j = exact[a]
            if cost[j] < best:
                best, source = cost[j], j
            a += 1
        best += more
        cost[i], came[i] = best, source
        best += p
        while len(queue) > head and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, p, i))
    out, i = [], m - 1
    while i:
        out.append(at[i])
        i = came[i]
    return np.array([0, *out[::-1]], dtype=np.int64)


def _pieces(ids: np.ndarray, begin: np.ndarray, keys: pa.Array, model: Encoder, number: int) -> tuple[pa.RecordBatch, int]:
    cuts = choose_cuts(*cut_places(ids, begin, model))
    start = np.union1d(begin[:-1], cuts[:-1])
    end = np.append(start[1:], len(ids))
    doc = np.searchsorted(begin, start, side="right") - 1
    own = np.searchsorted(cuts, start, side="right") - 1
    flat = ids.astype("<u4")
    crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(start.tolist(), end.tolist())), dtype=np.int64, count=len(start))
    columns = [start - begin[doc], end - start, crc, np.diff(begin)[doc], own + number, start - cuts[own]]
    batch = pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *map(pa.array, columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return batch, number + len(cuts) - 1


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, and its place: sequence_id and offset."""
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer, ranks)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            begin = np.append(0, np.cumsum(np.concatenate([np.diff(b) for _, b, _ in held])))
            batch, number = _pieces(np.concatenate([i for i, _, _ in held]), begin, pa.concat_arrays([k for _, _, k in held]), model, number)
            return batch

        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                ids, begin = model.encode(block.column(1))
                held.append((ids, begin, block.column(0)))
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def piece_ids(docs: DataFrame, pieces: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """``pieces`` with their ``ids``, cut anew from the texts of documents with unique ids."""
    spans = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spans"))
    joined = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).join(spans, "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer, ranks)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                ids, begin = model.encode(block.column(1))
                rows = [(k, s["sequence_id"], s["offset"], ids[b + s["start"] : b + s["start"] + s["length"]].tolist()) for k, b, spans in zip(block.column(0).to_pylist(), begin.tolist(), block.column(2).to_pylist()) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], block.column(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "sequence_id", "offset", "ids"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(work, f"doc_id {kind}, sequence_id long, offset long, ids array<long>")
