"""Words and shingles of Arrow text columns, by numpy over whole batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
Texts are UTF-8, in which those bytes never occur inside a longer character, so
the work is done on bytes. Words and shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes of text worked on at once: bounds a worker's memory whatever the batch.
BLOCK_BYTES = 2 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _byte_values() -> np.ndarray:
    values = np.arange(1, 257, dtype=np.uint64)
    values[65:91] += np.uint64(32)
    values[[0x20, *range(0x09, 0x0E)]] = 0
    return values


_VALUES = _byte_values()
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        steps = np.full(size, _MULT, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _inverse_table(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        steps = np.full(len(_power_table(n)), pow(int(_MULT), -1, 1 << 64), dtype=np.uint64)
        steps[0] = 1
        _inverses = np.cumprod(steps, dtype=np.uint64)
    return _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of a block of texts. ``first`` has len(texts) + 1 entries: the words of text i are first[i]:first[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray


def blocks(batch: pa.RecordBatch, text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index(text))
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(column: pa.Array, values: np.ndarray = _VALUES) -> Words:
    """Find and hash the words of a string column; ``values`` gives each byte its number, 0 where it parts words."""
    data, offsets = raw(column)
    none = np.zeros(0, dtype=np.int64)
    inside = values[data] != 0
    if not inside.any():
        return Words(data, offsets, none, none, np.zeros(len(offsets), dtype=np.int64), none.astype(np.uint64))
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = inside[edges]
    start = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = offsets[1:-1] - 1
    last = last[last >= 0]
    stop[last] = inside[last]
    end = np.flatnonzero(stop) + 1
    place = np.arange(start[0], len(data), dtype=np.int64)
    place -= np.repeat(start, np.diff(np.append(start, len(data))))
    place[~inside[start[0] :]] = 0
    terms = values[data[start[0] :]] * _power_table(int(place.max()) + 1)[place]
    code = mix(np.add.reduceat(terms, start - start[0]) + (end - start).astype(np.uint64) * _PLACE[0])
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), code)


def span_codes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the spans that tile ``data`` and begin at ``start`` (its first entry is 0)."""
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _power_table(len(data))[: len(data)], start)
    # Sums of powers counted from the block's start, divided by the power at the span's own start.
    size = np.diff(np.append(start, len(data)))
    return mix(sums * _inverse_table(len(data))[start] + size.astype(np.uint64) * _PLACE[0])


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's five-word windows and their len(texts) + 1 offsets.

    A text of one to four words has one: its whole sequence. One without words has none.
    """
    count = np.diff(w.first)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    at = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=at[1:])
    out = np.zeros(at[-1], dtype=np.uint64)
    if len(w.code) >= SHINGLE:
        top = len(w.code) - SHINGLE + 1
        window = np.zeros(top, dtype=np.uint64)
        for j in range(SHINGLE):
            window += w.code[j : j + top] * _PLACE[j]
        window = mix(window)
        long = np.flatnonzero(count >= SHINGLE)
        first = np.repeat(w.first[long], n[long])
        within = np.arange(len(first)) - np.repeat(np.cumsum(n[long]) - n[long], n[long])
        out[np.repeat(at[long], n[long]) + within] = window[first + within]
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        own = w.code[w.first[i] : w.first[i + 1]]
        out[at[i]] = mix(np.array([int((own * _PLACE[: len(own)]).sum(dtype=np.uint64)) ^ len(own)], dtype=np.uint64))[0]
    return out, at


def distinct_sorted(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The distinct values of each slice, ascending."""
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = np.sort(values[a:b])
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own)
    return out
