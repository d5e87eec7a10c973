from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tidecue.llm import pattern_packing as P

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def model():
    with open(TOKENIZER, encoding="utf-8") as f:
        return f.read()


def whole(model, text, length):
    """(start, length, crc) of each piece, by the library on the whole text."""
    ids = np.array([*tokenizers.Tokenizer.from_str(model).encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [(s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes())) for s in range(0, len(ids), length)]


def valid(rows, length):
    """Sequences without gaps, overlaps or excess; their number."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(held)


def used(plan, n):
    out = np.zeros(n, int)
    for times, parts in plan.groups:
        assert times > 0 and sum(s * t for s, t in parts) <= n - 1
        for s, t in parts:
            out[s] += times * t
    return out


def test_units_equal_whole_texts(model):
    rng = random.Random(2)
    odd = ["a", "B", "\u00c9", "e\u0301", "A\u0308", "I\u0307", "'", "'s", "'ll", "\u2019", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", ",", "\u0338", "<", "5", "\u0663", "\u00bd", "\u212a", "\u65e5\u672c",
           "\u1100\u1161", " ", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\x00", "\x7f", "\u00df", "\u03a3", "\U0001f600", "\u200d", "'T", "_", "-", "\u0958", "\ufb1d", "abc", "Hallo"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + [None, "", " ", "x" * 70000, "tak " * 30000]
    import pyarrow as pa

    batch, units = pa.record_batch([pa.array(texts)], ["text"]), P.Units(model)
    assert units.cut
    want = tokenizers.Tokenizer.from_str(model).encode_batch([t or "" for t in texts], add_special_tokens=False)
    seen = 0
    for lo, ids, at in P.text_ids(batch, "text", units):
        for i in range(len(at) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == [*want[lo + i].ids, 0], texts[lo + i][:80]
            seen += 1
    assert seen == len(texts)


def test_other_tokenizers_take_whole_texts():
    with open("/opt/tokenizers/byte_bpe_50k.json", encoding="utf-8") as f:
        other = f.read()
    import pyarrow as pa

    texts, units = ["Hello  there, it's", "a\nb", "", "caf\u00e9"], P.Units(other)
    assert not units.cut
    want = tokenizers.Tokenizer.from_str(other)
    for lo, ids, at in P.text_ids(pa.record_batch([pa.array(texts)], ["text"]), "text", units):
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*want.encode(t, add_special_tokens=False).ids, 0] for t in texts] and lo == 0


def test_least_squares():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.random((6, 14)), rng.normal(size=6)
        x = P.nonnegative_least_squares(a, b)
        gain = a.T @ (b - a @ x)
        # the conditions that hold at the optimum and nowhere else
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_patterns():
    from itertools import combinations_with_replacement

    want = {p for n in (1, 2, 3) for p in combinations_with_replacement(range(1, 13), n) if sum(p) == 12}
    got = {tuple(np.repeat(np.arange(1, 13), c.astype(int)).tolist()) for c in P.patterns(12, 3).T}
    assert got == want


def test_plans_hold_every_piece_and_are_short():
    rng = np.random.default_rng(5)
    for k in range(40):
        n = int(rng.integers(1, 400))
        counts = np.bincount(np.minimum((rng.exponential(n / 3 + 1, 5000 if k % 2 else 40)).astype(int) + 1, n), minlength=n + 1)
        plan = P.plan(counts)
        assert (used(plan, n + 1) == counts).all()
        assert plan.sequences <= 1.02 * (-(-int((counts * np.arange(n + 1)).sum()) // n)) + 1 + (counts[n // 2 + 1 :].sum() if k % 2 == 0 else 0)
    # from patterns, at best without a free token
    counts = np.zeros(2049, int)
    counts[[1000, 1048, 500, 524, 24]] = [7, 7, 4, 4, 100]
    plan = P.plan(counts)
    assert plan.fitted and plan.sequences == -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert P.plan(np.zeros(2049, int)).sequences == 0
    # a number of pieces beyond any table in memory
    many = P.plan(counts * 10**12)
    assert many.sequences <= plan.sequences * 10**12 and len(many.slots()) < 100


def test_packed_tables(spark, model):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["alpha", "be", "gamma,", "Delta", "it's"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60)), "x", i) for i in range(300)]
    rows += [(7, "same", "x", 1), (7, "same", "x", 1), (None, None, None, None), (None, "a b", None, 2), (900, text(1000), "y", 3), (901, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, piece int").repartition(3)
    got = P.pack_sequences(spark, docs, model, length=64).collect()
    want = sorted((str(r[0]), k, *p) for r in rows for k, p in enumerate(whole(model, r[1], 64)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    n, tokens = valid(got, 64), sum(r["length"] for r in got)
    assert n <= -(-tokens // 64) + 2
    assert P.pack_sequences(spark, docs.limit(0), model).collect() == []
    one = P.pack_sequences(spark, docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None)], docs.schema)), model).collect()
    assert [(r["length"], r["ids_crc32"], r["offset"]) for r in one] == [(1, zlib.crc32(b"\0" * 4), 0)]
