"""SentencePiece encoding and decoding in numpy batches: words of equal length advance together."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tok import _BASE, column, ids, mix

SPACE = "▁"
#: Encoded words that a worker keeps; cells of a batch's tables; length beyond which a word is encoded by itself; texts
#: of a step and their bytes; units of a text that are encoded at a time.
CACHE, CELLS, LONG, ROWS, BYTES, UNITS = 300_000, 400_000, 256, 1024, 4 << 20, 200_000
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# Fixed values of the model format: piece types, the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, b[i : i + n]
            i += n


@dataclass
class PieceModel:
    """The pieces of a model file, with their hashes sorted for probing."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool
    bpe: bool

    @staticmethod
    def load(raw: bytes) -> PieceModel:
        pieces, scores, kinds, prefix, bpe = [], [], [], True, False
        for f, v in _fields(raw):
            if f == 1:
                x = dict(_fields(v))
                pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                kinds.append(x.get(3, NORMAL))
            elif f == 2:
                bpe = dict(_fields(v)).get(3, 1) == 2
            elif f == 3:
                spec = dict(_fields(v))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models with the identity normaliser that keep all white space are supported")
        return PieceModel(pieces, np.array(scores), np.array(kinds), prefix, bpe)

    def __post_init__(self) -> None:
        use = np.flatnonzero((self.kinds == NORMAL) | (self.kinds == USER))
        self.longest = max((len(self.pieces[i]) for i in use), default=1)
        keys = np.array([_hash(_codes([self.pieces[i]]), len(self.pieces[i]))[0, 0] for i in use], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], use[order]
        # where the keys of each leading 20 bits start, and how many there are at most
        lead = (self.keys >> np.uint64(44)).astype(np.int64)
        self.start = np.full(1 << 20, -1, np.int32)
        self.start[lead[::-1]] = np.arange(len(lead), dtype=np.int32)[::-1]
        self.run = int(np.bincount(lead).max()) if len(lead) else 0
        # for words that are encoded by themselves; pieces of equal score share a rank, as the leftmost goes first
        self.index = {self.pieces[i]: int(i) for i in use[::-1]}
        self.gain = {p: float(self.scores[i]) for p, i in self.index.items()}
        levels = {x: r for r, x in enumerate(sorted(set(self.gain.values()), reverse=True))}
        self.rank = {p: levels[x] for p, x in self.gain.items()}
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0]) if (self.kinds == UNKNOWN).any() else -1
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.low = float(self.scores[use].min()) - UNKNOWN_PENALTY if len(use) else 0.0
        inverse = {i: bytes([x]) for x, i in self.bytes.items()}
        out = [inverse.get(i) or (b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        self.out_size = np.array([len(x) for x in out])
        self.out_start = np.concatenate([[0], np.cumsum(self.out_size)[:-1]])
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)

    def spans(self, codes: np.ndarray) -> np.ndarray:
        """The id of the piece of each length (last axis, from 1) from each place of each word, -1 for none."""
        w, n = codes.shape
        out = np.full((w, n, min(n, self.longest)), -1, np.int32)
        wide, h = codes.astype(np.uint64), np.ones((w, n), np.uint64)
        for size in range(1, out.shape[2] + 1):
            h = h[:, : n - size + 1] * _BASE + wide[:, size - 1 :]
            key = mix(h + np.uint64(size))
            first = self.start[key >> np.uint64(44)]
            row, at = np.nonzero(first >= 0)
            first, key = first[row, at], key[row, at]
            for step in range(self.run):
                found = np.minimum(first + step, len(self.keys) - 1)
                hit = self.keys[found] == key
                out[row[hit], at[hit], size - 1] = self.key_ids[found[hit]]
        return out

    def gains(self, spans: np.ndarray) -> np.ndarray:
        return np.where(spans >= 0, self.scores[spans], -np.inf)

    def spelled(self, char: int) -> list[int]:
        """What stands for a character without a piece."""
        raw = chr(char).encode(errors="replace")
        return [self.bytes[x] for x in raw] if len(self.bytes) == 256 else [self.unknown]

    def viterbi(self, spans: np.ndarray, gains: np.ndarray) -> np.ndarray:
        """Ends of the best segmentation: back[w, e] is the length of the segment that ends at e. The sum of scores is
        largest; ties go to the longer last segment. A character without a piece has the unknown score."""
        w, n, most = gains.shape
        gains = gains.copy()
        gains[:, :, 0] = np.where(spans[:, :, 0] >= 0, gains[:, :, 0], self.low)
        best = np.full((w, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((w, n + 1), np.int32)
        rows = np.arange(w)
        for end in range(1, n + 1):
            size = np.arange(min(end, most), 0, -1)
            score = best[:, end - size] + gains[:, end - size, size - 1]
            at = score.argmax(axis=1)
            best[:, end], back[:, end] = score[rows, at], size[at]
        return back

    def merges(self, spans: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Ends after merging, in each word the adjacent pair whose joint piece scores best (leftmost of equals), until
        none is left. In the form of ``viterbi``."""
        w, n, _ = spans.shape
        end = np.tile(np.arange(1, n + 2), (w, 1))  # of the segment from each place; place n ends the word
        end[:, n] = n
        alive = np.ones((w, n), bool)
        live = np.arange(w)
        while len(live) and n > 1:
            e = end[live]
            far = np.take_along_axis(e, e[:, :n], axis=1)
            size = far - np.arange(n)
            ok = alive[live] & (e[:, :n] < n) & (size <= scores.shape[2])
            gain = np.where(ok, np.take_along_axis(scores[live], np.minimum(size, scores.shape[2])[:, :, None] - 1, axis=2)[:, :, 0], -np.inf)
            at = gain.argmax(axis=1)
            row = np.arange(len(live))
            go = gain[row, at] > -np.inf
            live, at, row = live[go], at[go], row[go]
            alive[live, e[row, at]] = False
            end[live, at] = far[row, at]
        back = np.zeros((w, n + 1), np.int32)
        rows, starts = np.nonzero(alive)
        ends = end[rows, starts]
        back[rows, ends] = ends - starts
        return back

    def viterbi_long(self, word: str) -> np.ndarray:
        """``viterbi`` of one long word, from each place over the pieces that start there: the tables are the best sums and
        the backpointers only, ten bytes a character."""
        n, most, known = len(word), self.longest, self.gain
        best, back = array("d", [-math.inf]) * (n + 1), array("H", [0]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            for size in range(1, min(most, n - i) + 1):
                gain = known.get(word[i : i + size])
                if gain is None:
                    if size > 1:
                        continue
                    gain = self.low
                # earlier starts come first, so the longest of equals stays
                if here + gain > best[i + size]:
                    best[i + size], back[i + size] = here + gain, size
        return np.array(back, np.int32)

    def merges_long(self, word: str) -> np.ndarray:
        """``merges`` of one long word. The queue holds a number for each pair: the rank of its score, then its place."""
        n, rank = len(word), self.rank
        end, before, gone = array("i", range(1, n + 2)), array("i", range(-1, n)), bytearray(n + 1)
        end[n] = n

        def number(i: int) -> int:
            """Of the pair that starts at i, or -1."""
            mid = end[i]
            r = rank.get(word[i : end[mid]]) if mid < n and end[mid] - i <= self.longest else None
            return -1 if r is None else r << 40 | i

        queue = [x for i in range(n - 1) if (x := number(i)) >= 0]
        heapq.heapify(queue)
        while queue:
            x = heapq.heappop(queue)
            i = x & ((1 << 40) - 1)
            if gone[i] or number(i) != x:
                continue
            mid = end[i]
            gone[mid], end[i] = 1, end[mid]
            if end[i] < n:
                before[end[i]] = i
            for j in (before[i], i):
                if j >= 0 and (y := number(j)) >= 0:
                    heapq.heappush(queue, y)
        back = np.zeros(n + 1, np.int32)
        for i in range(n):
            if not gone[i]:
                back[end[i]] = end[i] - i
        return back

    def _ids_long(self, word: str, back: np.ndarray) -> bytes:
        sizes, at = array("i"), len(word)
        while at:
            sizes.append(back[at])
            at -= back[at]
        out = array("i")
        for size in reversed(sizes):
            piece = self.index.get(word[at : at + size], -1)
            out.extend([piece] if piece >= 0 else self.spelled(ord(word[at])))
            at += size
        return out.tobytes()

    def encode_long(self, word: str, ways: tuple[str, ...]) -> tuple[bytes, ...]:
        """int32 ids of one long word, for each of the ways."""
        return tuple(self._ids_long(word, getattr(self, f"{way}_long")(word)) for way in ways)

    def encode_words(self, words: list[str], ways: tuple[str, ...]) -> list[tuple[bytes, ...]]:
        """int32 ids of each word, for each of the ways ("merges", "viterbi")."""
        out: list[tuple[bytes, ...]] = [()] * len(words)
        size = np.fromiter(map(len, words), int, len(words))
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            n = size[order[lo]]
            if n > LONG:
                out[order[lo]] = self.encode_long(words[order[lo]], ways)
                lo += 1
                continue
            hi = min(int(np.searchsorted(size[order], n, side="right")), lo + max(1, CELLS // (int(n) * min(int(n), self.longest))))
            codes = _codes([words[i] for i in order[lo:hi]])
            spans = self.spans(codes)
            gains = self.gains(spans)
            done = [self._ids(codes, spans, getattr(self, way)(spans, gains)) for way in ways]
            for i, x in zip(order[lo:hi], zip(*done, strict=True), strict=True):
                out[i] = x
            lo = hi
        return out

    def _ids(self, codes: np.ndarray, spans: np.ndarray, back: np.ndarray) -> list[bytes]:
        w, n = codes.shape
        # only ends on the path back from the word's end count
        on = np.zeros((w, n + 1), bool)
        on[:, n] = True
        for end in range(n, 0, -1):
            rows = np.flatnonzero(on[:, end])
            on[rows, end - back[rows, end]] = True
        on[:, 0] = False
        rows, ends = np.nonzero(on)
        starts = ends - back[rows, ends]
        piece = spans[rows, starts, back[rows, ends] - 1].astype(np.int32)
        bounds = np.searchsorted(rows, np.arange(w + 1))
        raw = piece.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.unique(rows[piece < 0]):
            a, b = bounds[i], bounds[i + 1]
            out[i] = np.array([y for p, s in zip(piece[a:b], starts[a:b], strict=True) for y in ([p] if p >= 0 else self.spelled(int(codes[i, s])))], np.int32).tobytes()
        return out

    def decode(self, tokens: np.ndarray) -> bytes:
        """The text of ids, in UTF-8."""
        return self.decode_all(tokens, np.array([0, len(tokens)]))[0]

    def decode_all(self, tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts of several runs of ids (run i is offsets[i] to offsets[i + 1])."""
        at = np.concatenate([[0], np.cumsum(self.out_size[tokens])])[offsets].tolist()
        parts = []
        for lo in range(0, len(tokens), UNITS):
            part = tokens[lo : lo + UNITS]
            size = self.out_size[part]
            ends = np.cumsum(size)
            parts.append(self.out_bytes[np.arange(ends[-1]) + np.repeat(self.out_start[part] - (ends - size), size)].tobytes())
        raw = b"".join(parts)
        return [raw[a + (self.prefix and raw[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", errors="surrogatepass"), np.uint32).reshape(len(words), -1)


def _hash(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters from each place."""
    h = np.ones((codes.shape[0], codes.shape[1] - size + 1), np.uint64)
    for j in range(size):
        h = h * _BASE + codes[:, j : codes.shape[1] - size + 1 + j].astype(np.uint64)
    return mix(h + np.uint64(size))


class Encoder:
    """Encodes texts with a cache of words in two generations: when the younger is full it becomes the older, and
    words in use move on."""

    def __init__(self, model: PieceModel, ways: tuple[str, ...]) -> None:
        self.model, self.ways = model, ways
        self.young: dict[str, tuple[bytes, ...]] = {}
        self.old: dict[str, tuple[bytes, ...]] = {}

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, ...]]:
        short = [t if len(t) <= UNITS else "" for t in texts]
        split = [next(self._units(t), []) for t in short]
        self._learn(set().union(*split))
        for text, units in zip(texts, split, strict=True):
            if len(text) <= UNITS:
                yield self._joined(units)
            else:
                parts = []
                for units in self._units(text):
                    self._learn(set(units))
                    parts.append(self._joined(units))
                yield tuple(map(b"".join, zip(*parts, strict=True)))

    def _learn(self, units: set[str]) -> None:
        """Encode what is in neither generation."""
        self.long = {u: self.model.encode_long(self._word(u), self.ways) for u in units if len(u) > LONG}
        units = units - self.long.keys()
        wanted = units - self.young.keys()
        if len(self.young) + len(wanted) > CACHE:
            self.old, self.young = self.young, {}
            wanted = units
        moved = wanted & self.old.keys()
        new = list(wanted - moved)
        self.young.update((u, self.old[u]) for u in moved)
        self.young.update(zip(new, self.model.encode_words([self._word(u) for u in new], self.ways), strict=True))

    def _word(self, unit: str) -> str:
        return unit[1:] if unit[0] == "\0" else (SPACE if self.model.prefix else "") + unit

    def _joined(self, units: list[str]) -> tuple[bytes, ...]:
        if not units:
            return (b"",) * len(self.ways)
        got = [self.young[u] if len(u) <= LONG else self.long[u] for u in units]
        return tuple(map(b"".join, zip(*got, strict=True)))

    def _units(self, text: str) -> Iterator[list[str]]:
        """Words between single spaces as they are; any other text as marked runs (no piece has a space mark after
        another character, so neither way of encoding crosses them). UNITS at most at a time."""
        if self.model.prefix and text and text[0] != " " and "  " not in text and SPACE not in text and "\0" not in text and text[-1] != " ":
            while text:
                *units, text = text.split(" ", UNITS) if text.count(" ", 0, len(text)) >= UNITS else [*text.split(" "), ""]
                yield units
        elif text:
            found = _UNIT.finditer((" " * self.model.prefix + text).replace(" ", SPACE))
            while units := ["\0" + m.group() for m in islice(found, UNITS)]:
                yield units


def _run(model: PieceModel, ways: tuple[str, ...], full: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, ways)
        for batch in batches:
            data, offsets = column(batch, "text")
            hi = 0
            while hi < batch.num_rows:
                lo, hi = hi, min(hi + ROWS, batch.num_rows, max(hi + 1, int(np.searchsorted(offsets, offsets[hi] + BYTES, side="right")) - 1))
                part = batch.slice(lo, hi - lo)
                raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, lo + part.num_rows)]
                got = list(encoder.encode([t.decode() for t in raw]))
                arrays, names = [ids(part)], ["doc_id"]
                for k, way in enumerate(ways):
                    bounds = np.concatenate([[0], np.cumsum([len(g[k]) // 4 for g in got])])
                    flat = np.frombuffer(b"".join([g[k] for g in got]), np.int32)
                    if full:
                        arrays, names = [ids(part), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))], ["doc_id", "ids"]
                        break
                    same = [x == t for x, t in zip(model.decode_all(flat, bounds), raw, strict=True)]
                    arrays += [pa.array(np.diff(bounds)), pa.array([hashlib.sha256(g[k]).hexdigest() for g in got]), pa.array(same)]
                    names += [f"{way}_tokens", f"{way}_sha256", f"{way}_round_trip"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode_documents(docs: DataFrame, model: PieceModel, way: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int). ``way`` is "viterbi" (best sum of scores) or "merges";
    by default what the model file names. Null and empty texts give no ids."""
    way = way or ("merges" if model.bpe else "viterbi")
    return _of(docs).mapInArrow(_run(model, (way,), True), "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, model: PieceModel, ways: tuple[str, ...] = ("viterbi", "merges")) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read): doc_id and, for each way, the number of
    tokens, the SHA-256 of the ids (int32, little endian) and whether decoding them gives the text back. Null and empty
    texts have no tokens and give back an empty text. Very long texts and words are encoded whole. Ties between segmentations
    go as ``viterbi`` and ``merges`` say, repeated rows give equal rows, a null doc_id stays null, and an empty table
    gives an empty result."""
    kinds = ", ".join(f"{w}_tokens long, {w}_sha256 string, {w}_round_trip boolean" for w in ways)
    return _of(docs).mapInArrow(_run(model, ways, False), f"doc_id long, {kinds}")


def _of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def decode_documents(rows: DataFrame, model: PieceModel) -> DataFrame:
    """One row per row of ``rows`` (doc_id, ids): doc_id, text. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.decode(np.asarray(x or [], np.int64)).decode(errors="replace") for x in ids(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
