"""Packing into sequences of fixed length: few-document length patterns whose repeat counts are fitted to the histogram
of lengths by non-negative least squares and rounded; what they leave goes where it fits best.

Only the histogram, one number for each length up to the sequence length, reaches the driver, and the plan that comes
back is as small: which numbers of each length go where. Texts are read once.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import materialize
from ._tok import Chunk, chunks

#: Tokens of a sequence, and the id after each document.
LENGTH, END = 2048, 0
#: Grid steps of a sequence in the fit, the most documents of a pattern, and the shares of the fitted counts that are tried.
GRID, MOST, SHARES = 64, 4, (1.0, 0.75, 0.5, 0.25)
#: Units whose ids a worker keeps, the bytes of text that are encoded at once, and the units that one call encodes.
KEPT, CHUNK, JOINED = 500_000, 1 << 22, 256

#: The pre-tokenizer pattern for which texts may be cut into units (fixed value, from the public vocabulary file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of ASCII characters: 1 letters, 2 digits, 3 punctuation but for the apostrophe, 0 all others.
_KIND = np.array([(1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 * (c > 32 and c != 39)) if c < 127 else 0 for c in range(256)], np.uint8)

_workers: dict[str, Units] = {}


class Units:
    """The ids of units, pieces of a text that its tokenizer treats one by one. Each distinct unit of a chunk is encoded
    once, and short ones are remembered.

    With the normalisers and the pattern above no token reaches over white space, over the border between an ASCII letter and
    ASCII punctuation, or beside a digit (an apostrophe may belong to either side, so no border is seen there). Case does not
    matter but for letters that a following mark may be joined to. Words that spell an added token stay whole and as they
    are. Of other tokenizers the unit is the whole text."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self._forget()
        parts = json.loads(tokenizer)
        norm, pre = ((parts.get(k) or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        plain = [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
        self.cut = plain and [t["type"] for t in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": PATTERN} and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        added = parts.get("added_tokens") or []
        self.cut = self.cut and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        self.added = [t["content"].lower().encode() for t in added]
        # tokens that end a word, where there is such a mark, and may then stand for the border of joined units
        suffix = parts["model"].get("end_of_word_suffix") if self.cut else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _forget(self) -> None:
        self.known, self.ids, self.first = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, slot): the ids of units[i] are ids[first[slot[i]] : first[slot[i] + 1]]."""
        slot = pc.index_in(units, self.known)
        unknown = np.asarray(slot.is_null())
        slot = np.asarray(slot.fill_null(0)).astype(np.int64)
        if unknown.any():
            new = units.filter(pa.array(unknown))
            ids, first = self._encoded(new.to_pylist())
            slot[unknown] = np.arange(len(new)) + len(self.known)
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.first = np.append(self.ids, ids), np.append(self.first, first[1:] + self.first[-1])
        out = self.ids, self.first, slot
        if len(self.known) > KEPT:
            self._forget()
        return out

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units. Units of letters go joined by spaces: a token that ends a word ends the unit. Where there are
        more such tokens than units, the units go one by one, like all others."""
        found: list[list[int]] = [[]] * len(units)
        alone = [i for i, u in enumerate(units) if not u.isalpha()]
        words = [i for i, u in enumerate(units) if u.isalpha()]
        groups = [words[lo : lo + JOINED] for lo in range(0, len(words), JOINED)]
        if not self.ends.any():
            alone, groups = list(range(len(units))), []
        for at, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([units[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(at) and ends[-1] == len(ids):
                for i, lo, hi in zip(at, [0, *ends], ends, strict=False):
                    found[i] = ids[lo:hi]
            else:
                alone += at
        for lo in range(0, len(alone), 4096):
            at = alone[lo : lo + 4096]
            for i, e in zip(at, self.tokenizer.encode_batch_fast([units[i] for i in at], add_special_tokens=False), strict=True):
                found[i] = e.ids
        first = np.zeros(len(units) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=first[1:])
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(first[-1])), first

    def borders(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes without white space, the units' places there, each row's first unit)."""
        b, kind = c.data, _KIND[c.data]
        after = np.append(b[1:], np.uint8(0)) if len(b) else b
        low = np.where((b >= 65) & (b <= 90) & (after < 128), b + np.uint8(32), b)
        start = np.zeros(len(b) + 1, bool)
        start[1:-1] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        text = low.tobytes() if self.added else b""
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                w = int(np.searchsorted(c.starts, at, side="right")) - 1
                start[c.starts[w] + 1 : c.ends[w]] = False
                low[c.starts[w] : c.ends[w]] = b[c.starts[w] : c.ends[w]]
                at = text.find(token, int(c.ends[w]))
        start[c.starts] = True
        inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        starts = np.flatnonzero(start[:-1] & inside)
        return low[inside], np.append((np.cumsum(inside) - 1)[starts], np.count_nonzero(inside)), np.searchsorted(starts, c.offsets)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of size[i] numbers each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


def text_ids(batch: pa.RecordBatch, name: str, units: Units) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets) by chunks of rows: each row's ids, END after them."""
    for c in chunks(batch, name, size=CHUNK):
        if units.cut:
            letters, offsets, row_at = units.borders(c)
        else:
            letters, offsets, row_at = c.data, c.offsets, np.arange(len(c.offsets))
        spelled = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
        ids, first, slot = units.encode(spelled.dictionary)
        # one more entry, the end of a document, after the last unit of each row
        ids, first = np.append(ids, np.int32(END)), np.append(first, first[-1] + 1)
        entry = np.insert(slot[np.asarray(spelled.indices)] if len(slot) else np.zeros(0, np.int64), row_at[1:], len(first) - 2)
        size = first[entry + 1] - first[entry]
        out, at = ids[_spread(first[entry], size)], np.zeros(len(entry) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        yield c.lo, out.astype("<u4"), at[np.append(0, row_at[1:] + np.arange(1, len(row_at)))]


def document_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, cut after every ``length``, and (shard, place):
    the task that made the piece and its number there among the pieces of its length."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _workers.get(model.value) or _workers.setdefault(model.value, Units(model.value))
        shard, placed = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            for lo, ids, at in text_ids(batch, "text", units):
                n = np.diff(at)
                parts = (n + length - 1) // length
                row, piece = np.repeat(np.arange(len(n)), parts), _spread(np.zeros(len(n), np.int64), parts)
                start = piece * length
                size = np.minimum(length, n[row] - start)
                data, begin = memoryview(ids).cast("B"), (at[row] + start) * 4
                crc = np.fromiter((zlib.crc32(data[a : a + 4 * s]) for a, s in zip(begin.tolist(), size.tolist(), strict=True)), np.int64, len(size))
                order = np.argsort(size, kind="stable")
                lengths, begins, counts = np.unique(size[order], return_index=True, return_counts=True)
                place = np.empty(len(size), np.int64)
                place[order] = np.arange(len(size)) - np.repeat(begins, counts) + np.repeat(placed[lengths], counts)
                placed[lengths] += counts
                key_of = batch.column(0).take(pa.array(lo + row))
                yield pa.RecordBatch.from_arrays([key_of, *map(pa.array, (piece.astype(np.int32), start, size, crc, np.full(len(size), shard, np.int64), place))], _PIECE)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, shard long, place long")


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "place"]


def patterns(grid: int = GRID, most: int = MOST) -> np.ndarray:
    """All ways to fill a sequence of ``grid`` steps with at most ``most`` documents: a row for each number of steps (from 1),
    a column for each pattern, how often it has that number."""
    out: list[list[int]] = []

    def extend(parts: list[int], left: int, largest: int) -> None:
        if not left:
            out.append(parts)
            return
        for part in range(min(left, largest), -(-left // (most - len(parts))) - 1 if len(parts) < most else left, -1):
            if part:
                extend([*parts, part], left - part, part)

    extend([], grid, grid)
    table = np.zeros((grid, len(out)))
    for j, parts in enumerate(out):
        np.add.at(table[:, j], np.array(parts) - 1, 1)
    return table


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by active sets: the column that would help most enters, the fit over the columns
    that are in is exact, and what would turn negative leaves on the way there. At most as many columns as rows are in."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    enough = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(8 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= enough:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            to = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (to > 0).all():
                x[:] = 0
                x[at] = to
                break
            down = to <= 0
            step = float(np.min(x[at][down] / np.maximum(x[at][down] - to[down], 1e-300)))
            x[at] += step * (to - x[at])
            gone = at[down & (x[at] <= 1e-9 * max(1.0, float(x.max())))]
            used[gone] = False
            x[gone] = 0
            if not len(gone):
                break
    return x


@dataclass
class Plan:
    """What goes where: ``groups`` of equal sequences, (how many, [(length, times in each)]), the first ``fitted`` of them from
    patterns and the others opened for what those left."""

    groups: list[tuple[int, list[tuple[int, int]]]] = field(default_factory=list)
    fitted: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.groups)

    def slots(self) -> np.ndarray:
        """Rows (length, lo, times, first sequence, offset) by length and lo: of a length, the pieces numbered from lo on lie in the
        sequences from the first one on, ``times`` in each, one after the other from the offset on."""
        rows, numbered, sequence = [], defaultdict(int), 0
        for n, parts in self.groups:
            offset = 0
            for length, times in parts:
                rows.append((length, numbered[length], times, sequence, offset))
                numbered[length] += n * times
                offset += length * times
            sequence += n
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def plan(counts: np.ndarray, grid: int = GRID, most: int = MOST) -> Plan:
    """Sequences for counts[l] pieces of each length l, up to a sequence's length len(counts) - 1, as few as found.

    The repeat counts of all patterns on the grid (lengths rounded up) are fitted to the histogram. A share of them is rounded,
    and patterns are filled with exact lengths from their steps, the last two so that nothing stays free; a pattern for which
    there are no such lengths is left. What patterns leave goes, longest first, into the fullest sequence that has room, or into a
    new one. The shares are tried in turn until as few sequences are needed as the tokens fill: the less the patterns take,
    the more short pieces there are to fill up the rest. All of it works on counts: equal sequences are one group, and there are
    at most a few times as many groups as lengths, whatever the number of pieces."""
    length = len(counts) - 1
    grid = min(grid, length)
    table = patterns(grid, most)
    steps = (np.arange(length + 1) * grid + length - 1) // length
    binned = np.bincount(steps, weights=np.append(0, counts[1:]), minlength=grid + 1)[1:]
    weight = np.arange(1, grid + 1) / grid
    fit = nonnegative_least_squares(table * weight[:, None], binned * weight)
    fewest, best = -(-int((counts * np.arange(length + 1)).sum()) // length), None
    for share in SHARES:
        now = _filled(counts, table, np.rint(share * fit).astype(np.int64), steps)
        best = now if best is None or now.sequences < best.sequences else best
        if best.sequences == fewest:
            break
    return best


def _filled(counts: np.ndarray, table: np.ndarray, repeats: np.ndarray, steps: np.ndarray) -> Plan:
    length, grid = len(counts) - 1, len(table)
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = Plan()
    spaces: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)

    def close(n: int, parts: list[tuple[int, int]]) -> None:
        spaces[length - sum(s * t for s, t in parts)].append((n, parts))

    lowest = np.searchsorted(steps, np.arange(grid + 2))

    # patterns of few documents first: long pieces have the fewest partners
    for j in sorted(np.flatnonzero(repeats).tolist(), key=lambda j: (table[:, j].sum(), j)):
        *heads, before, last = [0, *np.repeat(np.arange(1, grid + 1), table[:, j].astype(int))[::-1].tolist()]
        todo = int(repeats[j])
        while todo:
            took: dict[int, int] = {}
            for step in heads[1:]:
                at = np.flatnonzero(left[lowest[step] : lowest[step + 1]])
                took[size] = took.get(size := int(lowest[step] + at[-1]) if len(at) else 0, 0) + 1
            room = length - sum(s * t for s, t in took.items())
            # the last two fill the sequence: of the pairs that do, the one there are most of
            pair = np.arange(lowest[before], lowest[before + 1]) if before else np.zeros(1, np.int64)
            pair = pair[pair <= room]
            there = np.minimum(np.where(pair > 0, left[pair], np.iinfo(np.int64).max), left[room - pair])
            if 0 in took or not len(pair) or not there.max():
                break
            x = int(pair[int(np.argmax(there))])
            for size in (x, room - x):
                if size:
                    took[size] = took.get(size, 0) + 1
            n = min(todo, *(int(left[s]) // t for s, t in took.items()))
            if not n:
                break
            for s, t in took.items():
                left[s] -= n * t
            close(n, list(took.items()))
            out.fitted += n
            todo -= n
    ordered = sorted(spaces)
    for size in range(length, 0, -1):
        todo = int(left[size])
        while todo:
            at = bisect_right(ordered, size - 1)
            if at == len(ordered):
                spaces[length].append((todo, []))  # as many new sequences as there could be need for; unused ones go back
                insort(ordered, length)
                at = len(ordered) - 1
            space = ordered[at]
            n, parts = spaces[space].pop()
            times = min(space // size, todo)
            take = min(n, todo // times)
            if take < n and space < length:
                spaces[space].append((n - take, parts))
            if not spaces[space]:
                del spaces[space]
                ordered.pop(at)
            now = space - times * size
            if now not in spaces:
                insort(ordered, now)
            spaces[now].append((take, [*parts, (size, times)]))
            todo -= take * times
    out.groups = [g for s in sorted(spaces) for g in spaces[s]]
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every document's ids (END after them), packed into as few sequences of at most ``length`` tokens as the plan finds.
    One row for each piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the JSON text of a tokenizer of the ``tokenizers`` library; no special tokens are added. Only documents of more
    than ``length`` tokens are cut. A null or empty text is a document of one token, END. Rows may repeat and share a key or have
    a null one: each row is a document of its own. Columns other than ``key`` and ``text`` play no part, whatever their names. Very
    long texts are encoded in one task, and make many pieces. An empty table gives an empty result.

    The task that cuts a piece numbers it among its pieces of that length, and the table of pieces keeps that number; a number
    among all pieces follows from the tasks' counts, so no length, however common, is ever sorted or held in one task.
    """
    pieces = materialize(spark, document_pieces(docs, tokenizer, key, text, length), "pieces")
    sizes = pieces.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(spark, sizes.select("length", "shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "starts")
    counts = np.zeros(length + 1, np.int64)
    for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length up to that of a sequence
        counts[r["length"]] = r["n"]
    slots = plan(counts).slots()
    # (length, lo) as one ascending number: pieces of a length take consecutive numbers after those of shorter ones
    base = np.concatenate([[0], np.cumsum(counts)])
    begin = base[slots[:, 0]] + slots[:, 1]
    sent = spark.sparkContext.broadcast((base, begin, slots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, begin, slots = sent.value
        for batch in batches:
            size, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            at = slots[np.searchsorted(begin, base[size] + number, side="right") - 1]
            k = number - at[:, 1]
            columns = [batch.column(c) for c in _PIECE[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 3] + k // at[:, 2]), pa.array(at[:, 4] + k % at[:, 2] * size)], [*_PIECE[:5], "sequence_id", "offset"])

    numbered = pieces.join(starts.drop("n"), ["length", "shard"]).select(*_PIECE[:5], (F.col("first") + F.col("place")).alias("number"))
    kind = docs.schema[key].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
