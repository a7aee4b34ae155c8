"""N-best SentencePiece segmentation: forward Viterbi, backward A-star.

The lattice of a text has an edge for every piece of the vocabulary that matches
at a place. Forward Viterbi gives each place its best score from the start; these
scores are the exact remaining costs of a backward A-star search from the end,
which therefore yields paths in order of score.

A piece's score is its log probability under a unigram model of the given
vocabulary: how often the model's own encoder uses it over all texts, smoothed.
(The vocabulary at hand is a BPE one, whose own scores are ranks of merges, which
do not add up along a path.) The words of all texts are counted and each distinct
word is encoded once. Scores are cut to SCORE_BITS binary digits, so sums are exact
and ties are ties in whatever order they are summed.

No piece crosses from a character into a following space mark, and a character
that no piece contains is spelled in bytes, so a text's lattice falls into
independent segments at those places. Each distinct segment is searched once per
worker (a bounded memory); the best paths of the whole text are the best
combinations of segment paths, found by the same search over score losses.

Defined results: null counts as empty, which has one segmentation without
pieces; ties go to the path with longer last pieces, then to earlier segments;
repeated rows give repeated results, null ids included; very long texts are encoded
whole; an empty table gives an empty one; other columns are ignored, whatever their
names. Decoding restores every text, save that the mark U+2581 reads as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
MARK = "▁"
#: A worker forgets its segments when they pass this many characters.
REMEMBERED_CHARS = 4_000_000
#: Distinct words that a task holds while it counts.
MOST_WORDS = 200_000
SCORE_BITS = 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: One lattice per model and n; other scores take its place, so a worker that outlives many jobs holds no more.
_loaded: dict[tuple[str, int], tuple[int, "Lattice"]] = {}


def _splitter(pieces: list[str]) -> re.Pattern:
    """Cuts a text only where no piece can cross: before a space mark, around
    characters of no piece, and after a letter where a character follows that
    follows a letter in no piece."""
    if any(re.search(f"[^{MARK}]{MARK}", name) for name in pieces):
        return re.compile(r"[\s\S]+")  # pieces cross words: one segment
    covered = set("".join(pieces)) - {MARK}
    pairs = {(x, y) for name in pieces for x, y in zip(name, name[1:])}
    letters = {c for c in covered if c.isalpha()}
    while more := {y for x, y in pairs if x in letters} - letters:
        letters |= more
    rest = covered - letters
    of = {k: "".join(map(re.escape, sorted(v))) for k, v in (("letters", letters), ("rest", rest), ("covered", covered))}
    lead = f"[{of['rest']}]*" if rest else ""
    tail = f"|{MARK}*[{of['rest']}]+" if rest else ""
    return re.compile(f"{MARK}*{lead}[{of['letters']}]+{tail}|{MARK}+|[^{of['covered']}{MARK}]")


def _hash(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.uint64)
    for k in range(points.shape[1]):
        out = out * _BASE + points[:, k] + np.uint64(1)
    return out


class Lattice:
    """The vocabulary of one model, and the N best paths of segments seen so far."""

    def __init__(self, path: str, n: int, scores: np.ndarray | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        size = model.get_piece_size()
        self.scores = np.array([model.get_score(i) for i in range(size)]) if scores is None else np.asarray(scores, dtype=float)
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        names = {model.id_to_piece(i): i for i in normal}
        #: Every piece and every proper prefix of one; a prefix that is no piece has None.
        self.pieces: dict[str, tuple[float, int] | None] = {}
        for name in names:
            for k in range(1, len(name)):
                self.pieces.setdefault(name[:k], None)
        for name, i in names.items():
            self.pieces[name] = (float(self.scores[i]), i)
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_score = float(self.scores[normal].min()) - 10.0
        self.spelled = [b""] * size
        for name, i in names.items():
            self.spelled[i] = name.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        self.split = _splitter(list(names))
        self.longest = max(map(len, names))
        self.tables = []
        for length in range(1, self.longest + 1):
            own = [name for name in names if len(name) == length]
            hashes = _hash(np.array([[ord(c) for c in name] for name in own], dtype=np.uint64).reshape(len(own), length))
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array([names[x] for x in own], dtype=np.int64)[order]))
        self.spelled_flat = np.frombuffer(b"".join(self.spelled), dtype=np.uint8)
        self.spelled_size = np.array([len(x) for x in self.spelled], dtype=np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.paths: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.best, self.loss, self.count, self.begin, self.ids = array("d"), array("d"), array("q"), array("q"), array("i")
        self.chars = 0

    def learn(self, segments: list[str]) -> None:
        """Best ids, best score and loss of the second best of new segments, by forward Viterbi over all of one length at once."""
        by_length: dict[int, list[str]] = {}
        for segment in segments:
            by_length.setdefault(len(segment), []).append(segment)
        for length, own in by_length.items():
            if length > 4 * self.longest or len(own) < 8:
                for segment in own:
                    found = self.search(segment)
                    self._add(segment, found[0][0], found[0][0] - found[1][0] if len(found) > 1 else float("inf"), found[0][1])
                continue
            for k in range(0, len(own), 8192):
                self._learn_block(own[k : k + 8192], length)

    def _add(self, segment: str, best: float, loss: float, ids) -> None:
        self.number[segment] = len(self.best)
        self.best.append(best)
        self.loss.append(loss)
        self.begin.append(len(self.ids))
        self.count.append(len(ids))
        self.ids.extend(ids)
        self.chars += len(segment) + 8

    def _learn_block(self, own: list[str], length: int) -> None:
        points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(own), length)
        rows = np.arange(len(own))
        first = np.full((length + 1, len(own)), -np.inf)
        second = first.copy()
        first[0] = 0.0
        step = np.zeros((length + 1, len(own)), dtype=np.int64)
        piece = np.zeros((length + 1, len(own)), dtype=np.int64)
        rolling = np.zeros(points.shape, dtype=np.uint64)
        edges: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for n in range(1, min(length, self.longest) + 1):
            rolling = rolling[:, : length - n + 1] * _BASE + points[:, n - 1 :].astype(np.uint64) + np.uint64(1)
            hashes, ids = self.tables[n - 1]
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, rolling), len(hashes) - 1)
                found = np.where(hashes[at] == rolling, ids[at], -1)
            else:
                found = np.full(rolling.shape, -1, dtype=np.int64)
            score = np.where(found >= 0, self.scores[found], -np.inf)
            if n == 1 and (lone := found < 0).any():
                wide = points[lone]
                score[lone] = self.byte_score * (1 + (wide >= 0x80) + (wide >= 0x800) + (wide >= 0x10000))
                found[lone] = -2 - wide.astype(np.int64)
            for i in range(length - n + 1):
                if (found[:, i] != -1).any():
                    edges.setdefault(i + n, []).append((n, found[:, i], score[:, i]))
        for j in range(1, length + 1):
            for n, found, score in reversed(edges[j]):  # the longest last piece first: it has the ties
                one, two = first[j - n] + score, second[j - n] + score
                better = one > first[j]
                second[j] = np.maximum(np.minimum(first[j], one), np.maximum(second[j], two))
                first[j] = np.where(better, one, first[j])
                step[j] = np.where(better, n, step[j])
                piece[j] = np.where(better, found, piece[j])
        at = np.full(len(own), length)
        backward = []
        while at.any():
            backward.append(np.where(at > 0, piece[at, rows], -1))
            at = at - np.where(at > 0, step[at, rows], 0)
        paths = np.array(backward[::-1]).T.tolist()
        loss = np.where(np.isfinite(second[length]), first[length] - second[length], np.inf)
        chosen = [[i for i in path if i != -1] for path in paths]
        for k in np.flatnonzero((np.array(paths) < -1).any(axis=1)).tolist():
            chosen[k] = [b for i in chosen[k] for b in ([i] if i >= 0 else self.in_bytes(chr(-2 - i))[1])]
        at = len(self.best)
        self.number.update(zip(own, range(at, at + len(own))))
        sizes = [len(ids) for ids in chosen]
        self.best.extend(first[length].tolist())
        self.loss.extend(loss.tolist())
        self.count.extend(sizes)
        self.begin.extend(accumulate(sizes[:-1], initial=len(self.ids)))
        self.ids.extend(chain.from_iterable(chosen))
        self.chars += len(own) * (length + 8)

    def search(self, segment: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best (score, ids) of a segment, best first."""
        end, pieces = len(segment), self.pieces
        ahead = [float("-inf")] * (end + 1)
        ahead[0] = 0.0
        into: list[list] = [[] for _ in range(end + 1)]
        for i in range(end):
            here = ahead[i]
            for j in range(i + 1, end + 1):
                hit = pieces.get(segment[i:j], 0)
                if hit == 0:
                    if j == i + 1:
                        hit = self.in_bytes(segment[i])
                    else:
                        break
                elif hit is None:
                    if j > i + 1:
                        continue
                    hit = self.in_bytes(segment[i])
                into[j].append((i, hit[0], hit[1]))
                if here + hit[0] > ahead[j]:
                    ahead[j] = here + hit[0]
        out: list[tuple[float, tuple[int, ...]]] = []
        heap = [(-ahead[end], end, 0, 0.0, None)]
        serial = 0
        while heap:
            _, at, _, behind, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0] if isinstance(path[0], tuple) else (path[0],)
                    path = path[1]
                out.append((behind, tuple(ids)))
                if len(out) == self.n:
                    break
                continue
            for i, score, piece in into[at]:
                serial += 1
                total = behind + score
                heapq.heappush(heap, (-(total + ahead[i]), i, serial, total, (piece, path)))
        return out

    def in_bytes(self, char: str) -> tuple[float, tuple[int, ...]]:
        spelled = tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))
        return self.byte_score * len(spelled), spelled

    def encode(self, texts: list[str]) -> list[tuple[list[tuple[float, list[tuple[int, tuple[int, ...]]]]], np.ndarray, np.ndarray]]:
        """Per text: the N best segmentations as (score, [(segment, its ids)] where they differ from the best), the best ids, and where segments begin in them."""
        if self.chars > REMEMBERED_CHARS:
            self.forget()
        split = [self.split.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        unknown = set().union(*split).difference(self.number)
        if unknown:
            self.learn(sorted(unknown))
        number = self.number
        best, loss, begin, count, known = (np.frombuffer(x, dtype=t) for x, t in ((self.best, "f8"), (self.loss, "f8"), (self.begin, "i8"), (self.count, "i8"), (self.ids, "i4")))
        out = []
        for segments in split:
            if not segments:
                out.append(([(0.0, [])], np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)))
                continue
            which = np.array([number[s] for s in segments], dtype=np.int64)
            own = count[which]
            end = np.cumsum(own)
            at = end - own
            ids = known[np.repeat(begin[which] - at, own) + np.arange(end[-1])]
            out.append((self.combine(float(best[which].sum()), segments, ids, at, own, loss[which]), ids, np.append(at, end[-1])))
        return out

    def alternatives(self, segment: str, best_ids: tuple[int, ...]) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n paths of a segment in order of score, the one in use first."""
        if segment not in self.paths:
            self.paths[segment] = self.search(segment)
            self.chars += 4 * len(segment)
        found = self.paths[segment]
        return [(found[0][0], best_ids), *[p for p in found if p[1] != best_ids]][: self.n]

    def combine(self, score: float, segments: list[str], ids: np.ndarray, at: np.ndarray, own: np.ndarray, losses: np.ndarray) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        """Best combinations: only the n - 1 segments that lose least can matter, as each gives a better one by itself."""
        least = np.argsort(losses, kind="stable")[: self.n - 1] if len(losses) < 64 else self._least(losses)
        options = [(int(p), self.alternatives(segments[p], tuple(ids[at[p] : at[p] + own[p]].tolist()))) for p in least if np.isfinite(losses[p])]
        heap: list = [(0.0, ())]
        seen = {()}
        out = []
        while heap and len(out) < self.n:
            loss, choice = heapq.heappop(heap)
            out.append((score - loss, [(options[o][0], options[o][1][k][1]) for o, k in choice]))
            chosen = dict(choice)
            for o, (_, paths) in enumerate(options):
                k = chosen.get(o, 0)
                if k + 1 < len(paths):
                    following = tuple(sorted((chosen | {o: k + 1}).items()))
                    if following not in seen:
                        seen.add(following)
                        heapq.heappush(heap, (loss + paths[k][0] - paths[k + 1][0], following))
        return out

    def _least(self, losses: np.ndarray) -> np.ndarray:
        if self.n < 2:
            return np.zeros(0, dtype=np.int64)
        bound = np.partition(losses, self.n - 2)[self.n - 2]
        near = np.flatnonzero(losses <= bound)
        return near[np.argsort(losses[near], kind="stable")][: self.n - 1]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        size = self.spelled_size[ids]
        end = np.cumsum(size)
        out = self.spelled_flat[np.repeat(self.spelled_at[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def lattice(path: str, n: int, scores: np.ndarray | None = None) -> Lattice:
    key, mark = (path, n), 0 if scores is None else zlib.crc32(scores.tobytes())
    if key in _loaded and _loaded[key][0] != mark:
        del _loaded[key]  # before the next one is built
    if key not in _loaded:
        _loaded[key] = mark, Lattice(path, n, scores)
    return _loaded[key][1]


def piece_scores(docs: DataFrame, *, text_col: str = "text", model: str = f"{TOKENIZER_DIR}/piece_bpe_32k.model") -> np.ndarray:
    """Log probability of every piece: its share of the model's own encoding of all words (runs without spaces), each piece with half a count more.

    One row per piece of the vocabulary reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update((text.as_py() or "").split(" "))
                if len(seen) > MOST_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        total = np.zeros(own.get_piece_size(), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = own.encode(part.column(0).to_pylist(), num_threads=1)
                times = np.repeat(part.column(1).to_numpy(), [len(x) for x in ids])
                np.add.at(total, np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=len(times)), times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["piece", "n"])

    import sentencepiece

    words = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("word <> ''")
    rows = words.mapInArrow(encode, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.full(sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size(), 0.5)
    for r in rows:
        counts[r["piece"]] += r["n"]
    return np.round(np.log(counts / counts.sum()) * 2.0**SCORE_BITS) / 2.0**SCORE_BITS


def nbest_encode(docs: DataFrame, *, n: int = 4, id_col: str = "doc_id", text_col: str = "text", model: str = f"{TOKENIZER_DIR}/piece_bpe_32k.model", scores: np.ndarray | None = None, with_ids: bool = True) -> DataFrame:
    """The ``n`` best segmentations of every whole text; a map without a shuffle. ``scores``: those of the pieces, by default ``piece_scores`` of the texts.

    Columns: id, n_pieces and best_score of the best one, scores of all (best
    first), ids_crc of the best ids (little-endian int32), round_trip (decoding the
    best ids restores the text), and with ``with_ids`` also ids (the best) and
    others: per further segmentation the changed spans (place and length in ids,
    replacement).
    """

    scores = piece_scores(docs, text_col=text_col, model=model) if scores is None else scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, n, scores)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for text, (best, ids, at) in zip(texts, own.encode(texts)):
                    others = [[{"place": int(at[p]), "length": int(at[p + 1] - at[p]), "ids": list(new)} for p, new in changes] for _, changes in best[1:]] if with_ids else None
                    rows.append((len(ids), best[0][0], [s for s, _ in best], zlib.crc32(ids.astype("<i4").tobytes()), own.decode(ids) == text, ids if with_ids else None, others))
                columns = list(zip(*rows))
                arrays = [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.list_(pa.float64())), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.bool_())]
                names = [id_col, "n_pieces", "best_score", "scores", "ids_crc", "round_trip"]
                if with_ids:
                    arrays += [pa.array(columns[5], pa.list_(pa.int32())), pa.array(columns[6], pa.list_(pa.list_(change)))]
                    names += ["ids", "others"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    change = pa.struct([("place", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"`{id_col}` {picked.schema['id'].dataType.simpleString()}, n_pieces long, best_score double, scores array<double>, ids_crc long, round_trip boolean"
    if with_ids:
        schema += ", ids array<int>, others array<array<struct<place:int,length:int,ids:array<int>>>>"
    return picked.mapInArrow(run, schema)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model: str = f"{TOKENIZER_DIR}/piece_bpe_32k.model") -> DataFrame:
    """(id, text) of piece ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, 1)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    picked = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema['id'].dataType.simpleString()}, text string")
