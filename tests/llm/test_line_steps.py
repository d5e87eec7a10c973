"""Steps of the line operator on batches, without Spark."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tidecue.llm import line_dedup
from tidecue.llm.groups import meetings


def test_pairs_are_told_apart_before_words_are_compared_one_by_one(monkeypatch):
    rng = random.Random(4)
    line = lambda n: np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
    pairs = [(line(n), line(n + n % 2)) for n in range(20, 120)]
    want = [False] * len(pairs)
    for n in (9, 10, 19, 20, 40, 200):
        for edits in range(n // 10 + 2):
            x = line(n)
            y, z = x.copy(), x.copy()
            y[:edits] += np.uint64(1)
            pairs += [(x, y), (x, np.concatenate([z[edits:], line(edits)])), (x, z[edits:])]
            want += [edits <= n // 10, 2 * edits <= n // 10, edits <= n // 10]
    # the words of one in another order have the same tally
    pairs.append((pairs[0][0], pairs[0][0][::-1]))
    want.append(False)
    compared, plain = [], line_dedup.within
    monkeypatch.setattr(line_dedup, "within", lambda x, y, most: compared.append(1) or plain(x, y, most))
    sides = [pa.array([p[j].tobytes() for p in pairs], pa.binary()) for j in (0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pairs))), pa.array(range(len(pairs))), *sides], ["a", "b", "ta", "tb"])
    got = {a for out in line_dedup._confirm(iter([batch])) for a in out.column(0).to_pylist()}
    assert got == {i for i, w in enumerate(want) if w}
    assert len(compared) < 80 < 100 < len(pairs)


def test_rows_of_cells_meet_once():
    rng = random.Random(2)
    rows = sorted((c, 2 if c % 3 == 0 else rng.randrange(2)) for c in range(40) for _ in range(rng.randrange(6)))
    cell, side = (np.array([r[j] for r in rows]) for j in (0, 1))
    number = np.unique(cell, return_inverse=True)[1]
    got = sorted((int(a), int(b)) for i, j in meetings(number, side) for a, b in zip(i, j, strict=True))
    assert got == [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if cell[i] == cell[j] and (side[i], side[j]) in ((0, 1), (2, 2))]


def test_only_named_lines_are_read_when_texts_are_cut(monkeypatch):
    texts = ["one two three\nfour five six\n\nseven eight", "one two three\nnine ten six", None, "eleven\n" * 500]
    keys = lambda t: [int(k) for c in line_dedup.chunks(pa.RecordBatch.from_pydict({"text": [t]}), lower=True, letters=True) for k in line_dedup.Lines.of(c, 1).key]
    gone = [[{"line": 1, "key": keys("Four five SIX")[0]}], [{"line": 1, "key": keys("four five six")[0]}], None, [{"line": 3, "key": keys("eleven")[0]}]]
    # rows 0 and 1 share a document, and the line named is the first one's
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 8, 9]), pa.array(texts), pa.array(gone)], ["doc_id", "text", "gone"])
    read, plain = [], line_dedup.Lines.of
    monkeypatch.setattr(line_dedup.Lines, "of", staticmethod(lambda c, n: read.append(len(c.data)) or plain(c, n)))
    for most, first in ((1.0, "one two three\n\nseven eight"), (0.3, texts[0])):
        (out,) = line_dedup._cut(1, True, "gone", most)(iter([batch]))
        assert out.column(1).to_pylist() == [first, texts[1], None, "eleven\n" * 499]
    assert sum(read) < 100


def test_pairs_of_few_edits_are_compared_side_by_side(monkeypatch):
    rng = random.Random(8)
    pairs = []
    for n in [*range(1, 60), 300, 640, 649, 700]:
        for _ in range(8):
            x = [rng.randrange(1, 12) for _ in range(n)]
            y = list(x)
            for _ in range(rng.randrange(n // 4 + 3)):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.randrange(2)] = [rng.randrange(1, 12)] * rng.randrange(2)
            pairs.append((np.array(x, np.uint64), np.array(y or [1], np.uint64)))
    want = {i for i, (x, y) in enumerate(pairs) if line_dedup.within(x, y, max(len(x), len(y)) // 10)}
    assert 100 < len(want) < len(pairs) - 100
    compared, plain = [], line_dedup.within
    monkeypatch.setattr(line_dedup, "within", lambda x, y, most: compared.append(most) or plain(x, y, most))
    # sides of a few pairs at a time, too
    for words in (1 << 17, 500):
        monkeypatch.setattr(line_dedup, "SIDE_BY_SIDE", words)
        sides = [pa.array([p[j].tobytes() for p in pairs], pa.binary()) for j in (0, 1)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(pairs))), pa.array(range(len(pairs))), *sides], ["a", "b", "ta", "tb"])
        assert {a for out in line_dedup._confirm(iter([batch])) for a in out.column(0).to_pylist()} == want
    assert all(most > 64 for most in compared)


def test_links_of_cells_name_components():
    line = [[rng.getrandbits(64) for _ in range(20)] for rng in [random.Random(5)]][0]
    texts = [line, [1, *line[1:]], [2, 3, *line[2:]], [*line[:18], 4, 5], list(range(20))]
    known, n = [10, 10, 12, 13, 14], len(texts)
    table = pa.table({"id": [10, 11, 12, 13, 14], "known": known, "side": [2] * n, "words": [20] * n, "sim": [0] * n, "text": pa.array([np.array(t, np.uint64).tobytes() for t in texts])})
    out = line_dedup._links(table, np.zeros(n, np.int64))
    links = {frozenset(p) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    assert links in ({frozenset((10, 12)), frozenset((10, 13))},)
