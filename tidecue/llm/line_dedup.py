"""Fuzzy line deduplication: buckets by smallest hashes in word windows, edit similarity, one occurrence per connected group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bit_filter, forget, free_name, materialize, maybe_in, n_parts
from ._tok import _BASE, Chunk, _powers, binary, chunks, column, ids, mix, runs
from .components import connected_components
from .groups import Forest, cells, different, in_cells, meetings, members_mark, neighbours

#: Lines of fewer words are left alone by default. Two lines are linked if at most 1/EDIT of the longer one's words have
#: to be edited.
MIN_WORDS, EDIT, GRAM, MARKS = 5, 10, 5, 16
BUCKET, BLOCK, BLOCK_WORDS = 4, 1024, 1 << 18
#: Marks that a task packs at a time.
PACK = 1 << 21
#: Lines of a larger bucket are sorted by so many words at their start, and at their end.
ENDS = 8
#: Words of lines that are compared side by side, and up to how many edits they are.
SIDE_BY_SIDE, FEW_EDITS = 1 << 17, 64


def _sketch(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each line, whether the number of its words in each of 64 hash classes is odd, as bits. An edit changes two
    bits at most. ``first`` holds the lines' first words and the end."""
    odd = np.zeros(len(h) + 1, np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << (h & np.uint64(63)), out=odd[1:])
    return odd[first[:-1] + size] ^ odd[first[:-1]]


def _run(n: int) -> int:
    """Words in a row that a line of ``n`` words has in common with any line within the edit bound, at least: k edits
    leave at most k + 1 runs of the longer line, with all but k of its words. 0 if nothing but an equal line is
    within the bound."""
    longer = [m for m in range(n, n * EDIT // (EDIT - 1) + 2) if m >= EDIT and m - m // EDIT <= n]
    return min((-(-(m - m // EDIT) // (m // EDIT + 1)) for m in longer), default=0)


#: For lines of so many words; longer ones have the last value.
RUNS = np.array([_run(n) for n in range(EDIT * EDIT + 1)])


def _marks(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of lines and their offsets, for lines at ``first`` of ``size`` words.

    They are the smallest hashes of GRAM words in all windows of RUNS words, of which the MARKS smallest stay. Lines within
    the edit bound have a run of at least so many words in common, so they have the smallest hash there in common too:
    whichever of the two windows is narrower, it fits into the other one around that place. Where a line has more
    than MARKS, that is so with high probability: lines of 40 words or more at the bound share 0.28 of their grams at least
    (an edit changes GRAM of them), so none of the MARKS smallest of both is shared in (1 - 0.28)**MARKS < 0.006 of
    such pairs, and in far fewer with less edits (in less than 2e-6 with half as many). Marks have 48 bits, the upper ones:
    with a line's number they are one number, which is sorted faster."""
    if len(size) > 1 << 16:
        some = [_marks(h, first[lo : lo + (1 << 16)], size[lo : lo + (1 << 16)]) for lo in range(0, len(size), 1 << 16)]
        return np.concatenate([v for v, _ in some]), np.append(0, np.cumsum(np.concatenate([np.diff(c) for _, c in some])))
    gram = runs(h, GRAM)
    width = np.maximum(0, RUNS[np.minimum(size, len(RUNS) - 1)] - GRAM + 1)
    line, value = [], []
    for w in np.unique(width[width > 0]):
        low = gram[: len(gram) - w + 1].copy()
        for j in range(1, w):
            np.minimum(low, gram[j : j + len(low)], out=low)
        which = np.flatnonzero(width == w)
        n = size[which] - GRAM - w + 2
        of = np.repeat(which, n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which], n)
        got = low[at]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (got[1:] != got[:-1])
        line.append(of[new])
        value.append(got[new])
    count = np.zeros(len(size) + 1, np.int64)
    if not line:
        return np.zeros(0, np.uint64), count
    both = np.concatenate(line).astype(np.uint64) << np.uint64(48) | np.concatenate(value) >> np.uint64(16)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])]
    line, value = (both >> np.uint64(48)).astype(np.int64), both << np.uint64(16)
    have = np.bincount(line, minlength=len(size))
    few = np.arange(len(line)) - np.repeat(np.cumsum(have) - have, have) < MARKS
    count[1:] = np.cumsum(np.minimum(have, MARKS))
    return value[few], count


def _lines(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of a chunk that has words: its row, its number in the row, and (with the end) its first word."""
    breaks = np.flatnonzero(c.data == 10)
    at = np.union1d(np.searchsorted(c.starts, breaks), c.first[:-1])
    at = at[at < len(c.starts)]
    row = np.searchsorted(c.first, at, side="right") - 1
    number = np.searchsorted(breaks, c.starts[at]) - np.searchsorted(breaks, c.offsets[row])
    return row, number, np.append(at, len(c.starts))


@dataclass
class Lines:
    """The lines of a chunk with enough words: row, number in the row, hash, first word and words; and all words' hashes."""

    row: np.ndarray
    number: np.ndarray
    key: np.ndarray
    first: np.ndarray
    size: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(c: Chunk, min_words: int) -> Lines:
        row, number, first = _lines(c)
        h, size = c.hashes(), np.diff(first)
        up, down = _powers(_BASE, len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        key = mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + size.astype(np.uint64)).view(np.int64)
        keep = size >= min_words
        return Lines(row[keep], number[keep], key[keep], first[:-1][keep], size[keep], h)


def _survey(min_words: int, parts: int) -> Callable:
    """A row for each line, and at times rows with the marks that a task met since: for each of ``parts`` ranges of marks
    the marks and their lines' keys, packed. A line's marks come once from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def lines(doc: pa.Array, x: Lines, sim: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(x.row), pa.binary())
            return pa.RecordBatch.from_arrays([doc, *[pa.array(v) for v in (x.number.astype(np.int64), x.key, sim.view(np.int64), x.size.astype(np.int32))], pa.nulls(len(x.row), pa.int32()), none, none], names)

        def marks() -> pa.RecordBatch:
            mark, key = (np.concatenate([h[j] for h in held]) for j in (0, 1))
            order = np.argsort(mark)
            mark, key = mark[order], key[order]
            # equal ranges of the 64-bit hashes
            cut = np.searchsorted(mark, (np.arange(parts + 1, dtype=np.float64) * (2.0**64 / parts))[1:-1].astype(np.uint64))
            cut = np.concatenate([[0], cut, [len(mark)]])
            part = np.flatnonzero(np.diff(cut))
            empty = [pa.nulls(len(part), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            packed = [binary([v[cut[p] : cut[p + 1]].tobytes() for p in part]) for v in (mark, key)]
            return pa.RecordBatch.from_arrays([*empty, pa.array(part.astype(np.int32)), *packed], names)

        names = ["doc_id", "line", "key", "sim", "words", "part", "marks", "keys"]
        for batch in batches:
            doc = ids(batch)
            for c in chunks(batch, lower=True, letters=True):
                x = Lines.of(c, min_words)
                if not len(x.row):
                    continue
                sim = _sketch(x.words, np.append(x.first, len(x.words)), x.size)
                yield lines(doc.take(pa.array(c.lo + x.row)), x, sim)
                long = np.flatnonzero(x.size >= EDIT - 1)
                fresh = [i for i, k in zip(long.tolist(), x.key[long].tolist(), strict=True) if k not in seen and not seen.add(k)]
                got, offsets = _marks(x.words, x.first[fresh], x.size[fresh])
                held.append((got, np.repeat(x.key[fresh], np.diff(offsets))))
                size += len(got)
                if size >= PACK:
                    yield marks()
                    held, size = [], 0
        if size:
            yield marks()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The marks of a range that lines with different keys have. A task sends each mark once, with its line's key or 0
    where it met several, so a common mark takes no more room here than there are tasks."""
    mark = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("marks")])
    key = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")])
    order = np.argsort(mark)
    mark, key = mark[order], key[order]
    first = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
    least = np.minimum.reduceat(key, first)
    several = (least != np.maximum.reduceat(key, first)) | (least == 0)
    return pa.table({"part": table.column("part")[:1], "shared": binary([mark[first[several]].tobytes()])})


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each mark of a packed row once: with 32 bits of its line's key, or 0 for several lines."""
    for batch in batches:
        marks, keys = [], []
        for m, k in zip(ids(batch, "marks"), ids(batch, "keys"), strict=True):
            m, k = np.frombuffer(m.as_buffer(), np.uint64), np.frombuffer(k.as_buffer(), np.uint64)
            first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            short = (k >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            several = np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)
            marks.append(m[first].tobytes())
            keys.append(np.where(several, np.uint32(0), short[first]).tobytes())
        yield pa.RecordBatch.from_arrays([ids(batch, "part"), binary(marks), binary(keys)], ["part", "marks", "keys"])


def _of_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (bucket, key) for each packed mark that is shared."""
    for batch in batches:
        for m, k, shared in zip(ids(batch, "marks"), ids(batch, "keys"), ids(batch, "shared"), strict=True):
            m, k, shared = np.frombuffer(m.as_buffer(), np.int64), np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(shared.as_buffer(), np.uint64)
            at = np.searchsorted(shared, m.view(np.uint64))
            ok = np.append(shared, np.uint64(0))[at] == m.view(np.uint64)
            ok &= at < len(shared)
            yield pa.RecordBatch.from_arrays([pa.array(m[ok]), pa.array(k[ok])], ["bucket", "key"])


def _fetch(min_words: int, wanted: Broadcast) -> Callable:
    """The word hashes of the lines whose hash is in the filter ``wanted``, once from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for c in chunks(batch, lower=True, letters=True):
                x = Lines.of(c, min_words)
                asked = np.flatnonzero(maybe_in(wanted.value, x.key))
                at = [i for i, k in zip(asked.tolist(), x.key[asked].tolist(), strict=True) if k not in seen and not seen.add(k)]
                yield pa.RecordBatch.from_arrays([pa.array(x.key[at]), binary([x.words[x.first[i] : x.first[i] + x.size[i]].tobytes() for i in at])], ["key", "text"])

    return run


def within(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether x becomes y by at most ``most`` insertions, deletions and replacements of words."""
    if abs(len(x) - len(y)) > most:
        return False
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = differ[0] if len(differ) else n
    x, y = x[start:], y[start:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    end = differ[0] if len(differ) else n
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not len(x) or not len(y) or abs(len(x) - len(y)) > most:
        return max(len(x), len(y)) <= most
    if len(x) == len(y) and int((x != y).sum()) <= most:
        return True
    if min(len(x), len(y)) > 8:  # words that one has more often than the other have to be edited
        both = np.concatenate([x, y])
        _, which = np.unique(both, return_inverse=True)
        more = np.bincount(which[: len(x)], minlength=which.max() + 1) - np.bincount(which[len(x) :], minlength=which.max() + 1)
        if max(more[more > 0].sum(), -more[more < 0].sum()) > most:
            return False
    return _diagonals(x.tolist(), y.tolist(), most) if most <= 64 else _band(x, y, most)


def _diagonals(x: list[int], y: list[int], most: int) -> bool:
    """Furthest places that e edits reach on each diagonal, for e up to ``most``."""
    n, m = len(x), len(y)
    reach = {0: 0}
    for e in range(most + 1):
        now: dict[int, int] = {}
        for d in range(-e, e + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1) if e else 0
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and x[i] == y[i + d]:
                i += 1
            if i >= n and i + d >= m:
                return True
            now[d] = i
        reach = now
    return False


def _band(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Rows of the edit table within a band of ``most`` to each side of the diagonal."""
    far = most + 1
    before = np.where(np.arange(-most, most + 1) >= 0, np.abs(np.arange(-most, most + 1)), far)
    shift = np.arange(-most, most + 1)
    for i in range(1, len(x) + 1):
        j = i + shift
        ok = (j >= 1) & (j <= len(y))
        same = np.zeros(len(shift), bool)
        same[ok] = y[j[ok] - 1] == x[i - 1]
        now = np.minimum(np.where(ok, before + ~same, far), np.append(before[1:], far) + 1)
        now = np.where(j == 0, i, np.where((j >= 0) & (j <= len(y)), now, far))
        # insertions run along the row
        now = np.minimum.accumulate(now - shift) + shift
        now = np.minimum(np.where((j >= 0) & (j <= len(y)), now, far), far)
        if now.min() > most:
            return False
        before = now
    return bool(before[len(y) - len(x) + most] <= most)


def _side_by_side(x: np.ndarray, first_x: np.ndarray, n: np.ndarray, y: np.ndarray, first_y: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which lines (``n`` words of ``x`` from ``first_x`` on) become those of ``y`` by at most ``most`` edits each: the rows of
    all edit tables at once, within a band to each side of the diagonal."""
    k = int(most.max())
    shift = np.arange(-k, k + 1, dtype=np.int16)[:, None]
    # a column for each pair; what lies beyond a line's end has no part in its result
    xs = x[np.minimum(first_x + np.arange(n.max())[:, None], len(x) - 1)]
    ys = y[np.clip(first_y + np.arange(-k, n.max() + k)[:, None], 0, len(y) - 1)]
    now = np.repeat(np.where(shift >= 0, shift, np.int16(k + 1)), len(n), axis=1)
    ok, pair = np.zeros(len(n), bool), np.arange(len(n))
    for i in range(1, len(xs) + 1):
        after = now + (ys[i - 1 : i + 2 * k] != xs[i - 1])
        np.minimum(after[:-1], now[1:] + np.int16(1), out=after[:-1])
        if i <= k:
            after[k - i], after[: k - i] = i, k + 1
        # insertions run along the row
        after -= shift
        np.minimum.accumulate(after, axis=0, out=after)
        after += shift
        now = after
        done = np.flatnonzero(n == i)
        ok[pair[done]] = now[(m - n + k)[done], done] <= most[done]
        if i % 8 == 0:
            goes_on = (n > i) & (now.min(axis=0) <= most)
            if 2 * goes_on.sum() < len(n):
                xs, ys, now = xs[:, goes_on], ys[:, goes_on], now[:, goes_on]
                n, m, most, pair = n[goes_on], m[goes_on], most[goes_on], pair[goes_on]
                if not len(n):
                    break
    return ok


def _alike(x: np.ndarray, at_x: np.ndarray, i: np.ndarray, y: np.ndarray, at_y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which lines ``i`` of ``x`` are within the edit bound of lines ``j`` of ``y``."""
    n, m = at_x[i + 1] - at_x[i], at_y[j + 1] - at_y[j]
    most = np.maximum(n, m) // EDIT
    ok = np.zeros(len(i), bool)
    for p in np.flatnonzero((most > FEW_EDITS) | (np.minimum(n, m) == 0)).tolist():
        ok[p] = within(x[at_x[i[p]] : at_x[i[p] + 1]], y[at_y[j[p]] : at_y[j[p] + 1]], int(most[p]))
    rest = np.flatnonzero((most <= FEW_EDITS) & (np.minimum(n, m) > 0) & (np.abs(n - m) <= most))
    rest = rest[np.argsort(-np.maximum(n, m)[rest], kind="stable")]
    lo = 0
    while lo < len(rest):
        p = rest[lo : lo + max(1, SIDE_BY_SIDE // int(max(n[rest[lo]], m[rest[lo]])))]
        ok[p] = _side_by_side(x, at_x[i[p]], n[p], y, at_y[j[p]], m[p], most[p])
        lo += len(p)
    return ok


def _near(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether lines (words, sketch) may be within the edit bound."""
    most = np.maximum(x[0], y[0]) // EDIT
    return (np.abs(x[0] - y[0]) <= most) & (np.bitwise_count((x[1] ^ y[1]).view(np.uint64)) <= 2 * most)


def _packed(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of binary texts one after the other, and where each begins (with the end)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    size = np.asarray(pa.compute.binary_length(texts)).astype(np.int64) // 8
    first = np.append(0, np.cumsum(size))
    words = np.frombuffer(b"".join(x.as_buffer() for x in texts), np.uint64) if first[-1] else np.zeros(0, np.uint64)
    return words, first


def _tally(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words in each of 128 hash classes, a row for each text: an edit changes the sum of differences by two at most."""
    n = len(first) - 1
    at = np.repeat(np.arange(n) * 128, np.diff(first)) + ((words >> np.uint64(6)) & np.uint64(127)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=128 * n), 1 << 14).astype(np.int16).reshape(n, 128)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            batch = whole.slice(lo, 1024)
            (x, at_x), (y, at_y) = (_packed(ids(batch, c)) for c in ("ta", "tb"))
            size = np.diff(at_x), np.diff(at_y)
            most = np.maximum(*size) // EDIT
            ok = np.abs(_tally(x, at_x) - _tally(y, at_y)).sum(axis=1, dtype=np.int64) <= 2 * most
            # lines of the same length are mostly told by their words place by place
            same = np.flatnonzero(ok & (size[0] == size[1]))
            n = size[0][same]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = np.append(0, np.cumsum(x[np.repeat(at_x[same], n) + inside] != y[np.repeat(at_y[same], n) + inside]))
            sure = np.zeros(len(ok), bool)
            sure[same] = np.diff(differ[np.append(0, np.cumsum(n))]) <= most[same]
            unsure = np.flatnonzero(ok & ~sure)
            ok[unsure] = _alike(x, at_x, unsure, y, at_y, unsure)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([ids(batch, "a").filter(keep), ids(batch, "b").filter(keep)], ["a", "b"])


def _meeting(table: pa.Table, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of cells that meet, are not connected and may be within the edit bound."""
    side, known, words, sim = (np.asarray(table.column(x)).astype(np.int64) for x in ("side", "known", "words", "sim"))
    for i, j in meetings(cell, side):
        new = known[i] != known[j]
        i, j = i[new], j[new]
        ok = _near([words[i], sim[i]], [words[j], sim[j]])
        yield i[ok], j[ok]


def _open(table: pa.Table, cell: np.ndarray) -> pa.RecordBatch:
    """The rows of cells that may be linked with another one there: only their texts are needed."""
    some = np.zeros(len(cell), bool)
    for i, j in _meeting(table, cell):
        some[i] = some[j] = True
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.filter(pa.array(some)).columns], table.schema.names)


def _links(table: pa.Table, cell: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) of components that ``known`` leaves apart in cells."""
    known = np.asarray(table.column("known"))
    words, first = _packed(table.column("text"))
    size, tally = np.diff(first), _tally(words, first)
    # differences of sums are no larger than the sums of differences, and quicker
    coarse = tally.reshape(len(known), 8, 16).sum(axis=1, dtype=np.int32)
    forest, a, b = Forest(len(known)), [], []
    order = np.lexsort((known, cell))
    for x, y in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        if cell[x] == cell[y] and known[x] == known[y]:
            forest.join(x, y)
    for left, right in _meeting(table, cell):
        most = 2 * (np.maximum(size[left], size[right]) // EDIT)
        near = np.zeros(len(left), np.int32)
        for k in range(coarse.shape[1]):
            near += np.abs(coarse[left, k] - coarse[right, k])
        left, right = left[near <= most], right[near <= most]
        for lo in range(0, len(left), 4096):
            i, j = left[lo : lo + 4096], right[lo : lo + 4096]
            ok = np.abs(tally[i] - tally[j]).sum(axis=1, dtype=np.int64) <= 2 * (np.maximum(size[i], size[j]) // EDIT)
            ok[ok] = [forest.root(x) != forest.root(y) for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True)]
            i, j = i[ok], j[ok]
            alike = _alike(words, first, i, words, first, j)
            for x, y in zip(i[alike].tolist(), j[alike].tolist(), strict=True):
                if forest.join(x, y):
                    a.append(int(known[x]))
                    b.append(int(known[y]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _cut(min_words: int, full: bool, named: str = "gone", most: float = 1.0) -> Callable:
    """Texts without the lines named (by number and hash) in the column ``named``; whole where those have more than the
    share ``most`` of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch, "text")
            gone = ids(batch, named)
            count = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(gone), 0))
            each = gone.flatten()
            of, number, key = np.repeat(np.arange(len(count)), count), np.asarray(each.field("line")), np.asarray(each.field("key"))
            lines = {i: data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") for i in np.flatnonzero(count).tolist()}
            drop: dict[int, set[int]] = {i: set() for i in lines}
            lost = np.zeros(batch.num_rows, np.int64)
            # rows may share a doc_id, so a line counts if its hash is the one named; no other line is read
            has = number < np.array([len(lines.get(i, ())) for i in range(batch.num_rows)], np.int64)[of]
            of, number, key = of[has], number[has], key[has]
            said = pa.array([lines[i][n] for i, n in zip(of.tolist(), number.tolist(), strict=True)], pa.large_binary()).cast(pa.large_string())
            for c in chunks(pa.RecordBatch.from_arrays([said], ["text"]), lower=True, letters=True):
                x = Lines.of(c, min_words)
                row = c.lo + x.row
                same = x.key == key[row]
                for i, n in zip(of[row[same]].tolist(), number[row[same]].tolist(), strict=True):
                    drop[i].add(n)
                np.add.at(lost, of[row[same]], x.size[same])
            if most < 1 and drop:
                rows = np.array(list(drop))
                for c in chunks(pa.RecordBatch.from_arrays([ids(batch, "text").take(pa.array(rows))], ["text"]), letters=True):
                    for i in rows[c.lo : c.hi][lost[rows[c.lo : c.hi]] > most * np.diff(c.first)].tolist():
                        drop[i] = set()
            texts: list[bytes | None] = [None] * batch.num_rows
            for i, d in drop.items():
                if d:
                    texts[i] = b"\n".join(x for j, x in enumerate(lines[i]) if j not in d)
            if full:
                text = ids(batch, "text")
                changed = pa.array([t is not None for t in texts])
                new = pa.array([t.decode() if t is not None else None for t in texts], text.type)
                arrays = [pa.compute.if_else(changed, new, text) if f == "text" else ids(batch, f) for f in batch.schema.names if f != named]
                yield pa.RecordBatch.from_arrays(arrays, [f for f in batch.schema.names if f != named])
            else:
                breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
                n = np.diff(np.searchsorted(breaks, offsets)) + (np.diff(offsets) > 0)
                removed = np.zeros(batch.num_rows, np.int64)
                removed[list(drop)] = [len(d) for d in drop.values()]
                sha = [hashlib.sha256(data[offsets[i] : offsets[i + 1]] if t is None else t).hexdigest() for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([ids(batch), pa.array(n.astype(np.int64)), pa.array(removed), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return run


def repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines to remove: doc_id, line (number from 0), key (the line's hash), group.

    Lines are the parts of a text between newlines; normalised they are their words (runs of letters and digits), A-Z
    in lower case. Equal
    normalised lines are one class. All classes whose word sequences are within an edit similarity of 1 - 1/EDIT are
    linked (at the bound itself too), and of each connected group the first occurrence by (doc_id, line) stays. Lines
    with fewer than ``min_words`` words, null and empty texts and rows with a null doc_id take no part; texts and lines count
    whole, however long. Rows that share a doc_id are one document, so equal lines at one place of them all stay. Extra
    columns are not read. An empty table gives an empty result.

    Method: a line's normalised words are hashed, and lines within the edit bound have a run of words in common (pigeonhole:
    k edits leave k + 1 runs), so they share a bucket: the smallest hash of GRAM words there (of long lines with probability over 0.998, see ``_marks``). Small buckets
    give their pairs; in large ones lines meet those that begin or end like them, and what is then not connected is compared in
    blocks. Edit similarity confirms every link.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    parts = n_parts(spark)
    kinds = "doc_id long, line long, key long, sim long, words int, part int, marks binary, keys binary"
    survey = materialize(spark, docs.mapInArrow(_survey(min_words, parts), kinds), "survey")
    lines = materialize(spark, survey.where("part is null").select("doc_id", "line", "key", "sim", "words"), "lines")
    classes = materialize(spark, lines.groupBy("key", "sim", "words").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")), "classes")
    # which marks lines have in common is found from packed ranges; only those become rows
    packed = survey.where("part is not null").select("part", "marks", "keys")
    shared = packed.mapInArrow(_once, "part int, marks binary, keys binary").groupBy("part").applyInArrow(_shared, "part int, shared binary")
    shared = materialize(spark, shared, "shared")
    index = packed.join(shared.hint("merge"), "part").mapInArrow(_of_shared, "bucket long, key long")
    # a class comes once from each task that met it
    index = materialize(spark, index.distinct(), "index")
    forget(spark, survey, shared)
    # what a bucket holds is aggregated on the map side and joined back, so that a bucket of any size is split like other rows
    sized = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *members_mark("key")).where("size > 1")
    # lines that share a passage share all its marks: of buckets with the same lines one is enough
    sized = materialize(spark, different(sized), "sized")
    buckets = materialize(spark, index.join(sized.hint("shuffle_hash"), "bucket").join(classes.select("key", "sim", "words").hint("shuffle_hash"), "key"), "buckets")
    forget(spark, index, sized)

    small = buckets.where(F.col("size") <= BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("words", "key", "sim"))).alias("m"))
    most = lambda y: F.floor(y["words"] / EDIT)
    near = lambda x, y: (y["words"] - x["words"] <= most(y)) & (F.bit_count(x["sim"].bitwiseXOR(y["sim"])) <= 2 * most(y))
    after = lambda x, i: F.transform(F.filter(F.slice("m", i + 2, BUCKET), lambda y: near(x, y)), lambda y: F.struct(F.least(x["key"], y["key"]).alias("a"), F.greatest(x["key"], y["key"]).alias("b")))
    pairs = materialize(spark, small.select(F.explode(F.flatten(F.transform("m", after))).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    large = buckets.where(F.col("size") > BUCKET).select(F.col("bucket").alias("group"), F.col("key").alias("id"), F.col("words").alias("mass"), "words", "sim")

    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(large.select("id")).distinct()
    # texts stay where they are: a filter of fixed size goes to them, and the lines that pass are joined
    wanted = materialize(spark, wanted, "wanted")
    text = docs.select("text").mapInArrow(_fetch(min_words, bit_filter(spark, wanted, "key", hashed=True)), "key long, text binary")
    text = text.join(wanted, "key", "left_semi").dropDuplicates(["key"])
    # the ends have columns of their own, as they are read alone
    ends = F.substring("text", 1, 8 * ENDS).alias("start"), F.expr(f"substring(text, greatest(1, length(text) - {8 * ENDS - 1}))").alias("stop")
    text = materialize(spark, text.select("key", "text", *ends), "words")
    forget(spark, wanted)
    # lines of a large bucket meet those that begin or end like them
    deep = large.drop("mass").hint("shuffle_hash").join(text.select(F.col("key").alias("id"), "start", "stop"), "id")
    deep = materialize(spark, deep.select("group", "start", "stop", "id", "words", "sim"), "deep")
    near = [neighbours(deep.select("group", F.col(c).alias("rest"), "id", "words", "sim"), _near, ("words", "sim")) for c in ("start", "stop")]
    of = lambda c: text.select(F.col("key").alias(c), F.col("text").alias(f"t{c}"))
    links = pairs.union(near[0]).union(near[1]).distinct().hint("shuffle_hash").join(of("a"), "a").join(of("b"), "b").mapInArrow(_confirm, "a long, b long")
    links = materialize(spark, links, "near")
    forget(spark, pairs, deep)
    comp = materialize(spark, connected_components(spark, links), "components")
    # who may be linked in a cell is told by length and sketch; only those lines' texts go there
    apart = cells(large, comp, BLOCK, BLOCK_WORDS, ("words", "sim"))
    cell = "group long, x int, y int, id long, known long, side int, words int, sim long"
    apart = materialize(spark, in_cells(apart.select("group", "x", "y", "id", "known", "side", "words", "sim"), _open, cell), "apart")
    closing = materialize(spark, in_cells(apart.hint("shuffle_hash").join(text.select(F.col("key").alias("id"), "text"), "id"), _links, "a long, b long"), "closing")
    forget(spark, buckets, text, links, apart)
    if not closing.isEmpty():
        # components take the place of their members, and are few
        joined = materialize(spark, connected_components(spark, closing), "joined").select(F.col("node").alias("was"), F.col("component").alias("is"))
        comp = comp.union(joined.select("was", "was")).distinct()
        comp = comp.join(joined, F.col("component") == F.col("was"), "left").select("node", F.coalesce("is", "component").alias("component"))
    # a class of one line that is linked with none loses none
    grouped = classes.join(comp.hint("shuffle_hash"), F.col("key") == F.col("node"), "left").where("component is not null or n > 1")
    grouped = materialize(spark, grouped.select("key", F.coalesce("component", "key").alias("group"), "first_doc"), "grouped")
    stays = grouped.groupBy("group").agg(F.min("first_doc").alias("stays"))
    named = lines.select("doc_id", "line", "key").join(grouped.select("key", "group").join(stays, "group").hint("shuffle_hash"), "key")
    named = materialize(spark, named, "named")
    forget(spark, lines, classes, grouped)
    # of the document that keeps a group's line, its first
    first = named.where("doc_id = stays").groupBy("group", "doc_id").agg(F.min("line").alias("line"))
    return named.join(first.hint("shuffle_hash"), ["group", "doc_id", "line"], "left_anti").select("doc_id", "line", "key", "group")


def _per_document(gone: DataFrame, doc_id: str = "doc_id", named: str = "gone") -> DataFrame:
    return gone.groupBy(F.col("doc_id").alias(doc_id)).agg(F.collect_set(F.struct("line", "key")).alias(named))


def count_repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left, UTF-8; null
    and empty texts have no lines). Other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = _per_document(repeated_lines(spark, docs, min_words))
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_cut(min_words, False), "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, most: float = 1.0) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text``; every row and column stays, whatever the columns are called, and a
    text may become empty. Texts that would lose more than the share ``most`` of their words stay whole: they are copies
    as documents, for a step that compares documents."""
    of, named = free_name(docs, "_of"), free_name(docs, "_gone")
    gone = _per_document(repeated_lines(spark, docs, min_words), of, named)
    both = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(of), "left").select(*docs.columns, named)
    return both.mapInArrow(_cut(min_words, True, named, most), docs.schema)
