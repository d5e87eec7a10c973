from __future__ import annotations

import math
import os
import pickle
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecue.llm import ann, audio, licenses, packing, pieces, quality, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# -- vectors


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 64)
    monkeypatch.setattr(ann, "QUERIES", 8)
    rng = np.random.default_rng(0)
    v = rng.standard_normal((500, 24)) * rng.uniform(0.1, 3, (500, 1))
    v[10] = v[11] = v[12]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [1.0] * 5), (None, [1.0] * 24), (905, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(4)
    got = {}
    for r in ann.nearest(spark, df, df.where("vec_id % 20 = 0 or vec_id > 899")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 500, 20):
        s = (v * v[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort([np.arange(500), -s])[:20]
        assert [x[0] for x in got[q]] == list(range(1, 21))
        hits += len(set(best) & {x[1] for x in got[q]})
        for _, i, score in got[q]:
            assert score == pytest.approx(float(v[i] @ v[q]), rel=1e-12)
    assert hits / (25 * 20) >= 0.99 and set(got) == set(range(0, 500, 20))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(spark, df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 2.0), (0, 2, 20, 1.0), (20, 1, 3, 2.0), (20, 2, 0, 1.0)]
    assert ann.nearest(spark, df.limit(0), df.limit(0)).count() == 0


def test_code_estimates_stay_within_bounds():
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((400, 32)), rng.standard_normal((50, 32))
    turn = ann.rotation(32, 128)
    assert np.allclose(turn.T @ turn, np.eye(32), atol=1e-5)
    codes, norms, fit = ann.encode(v, turn)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    guess = (q @ turn.T @ signs.T) * norms / (fit * math.sqrt(128))
    bound = np.linalg.norm(q, axis=1)[:, None] * norms * np.sqrt(1 - fit**2) / fit * ann.EPSILON / math.sqrt(127)
    assert (np.abs(guess - q @ v.T) <= bound).mean() > 0.995


def brute_nearest(rows, q, k=20):
    """Exact products in Python's fractions of the vectors, rounded once."""
    from fractions import Fraction

    scores = [(float(sum(Fraction(a) * Fraction(b) for a, b in zip(v, rows[q], strict=True))), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])]
    return [i for _, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.mark.parametrize("size", [1.0, 1e39, 1e140, 1e-140, 1e-155])
def test_no_finite_vector_is_lost(spark, size):
    """Very large and very small vectors, and vectors of other lengths, are candidates like all others."""
    rng = np.random.default_rng(1)
    rows = {i: [float(x) for x in v] for i, v in enumerate(rng.standard_normal((60, 8)) * size)}
    rows |= {60: [0.0] * 7 + [size * 1e-30], 61: [size * 1e3] + [0.0] * 7, 100: [size, size], 101: [size, -size], 120: [size]}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(spark, df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: want for q in rows if q % 20 == 0 and (want := brute_nearest(rows, q))} and got[100] == [101]


@pytest.mark.parametrize("size", [2.0**700, 2.0**-700, 2.0**-1070, 2.0**1023])
def test_blocks_keep_vectors_whose_products_leave_doubles_range(size):
    v = np.sign(np.random.default_rng(2).standard_normal((100, 16))) * size
    block = ann.Block.of(np.arange(100), v)
    (best, *_), seen = ann.search_block(block, np.array([0]), v[:1], 20)
    score = np.array([sum(np.sign(v[i]) * np.sign(v[0])) for i in range(100)])
    assert len(best[0]) == 20 and seen >= 20 and not np.isnan(best[1]).any()
    if size > 1:  # all products are infinite, so ties go to the smaller key
        assert best[0].tolist() == [i for i in range(1, 100) if score[i] > 0][:20]


def test_a_query_of_mixed_sizes_finds_all(spark):
    df = spark.createDataFrame([(0, [1e39, 1.0]), (20, [2e39, 1.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in ann.nearest(spark, df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 20), (0, 3)]


def test_packed_estimates_equal_the_codes_product():
    rng = np.random.default_rng(5)
    v, q = rng.standard_normal((300, 40)), rng.standard_normal(40) / 8
    block = ann.Block.of(np.arange(300), v)
    x, exponents = ann.scaled(v)
    codes, norms, fit = ann.encode(x, ann.rotation(40, 192))
    plain = ((np.unpackbits(codes, axis=1) * 2.0 - 1) @ (ann.rotation(40, 192) @ q)) * norms / (fit * math.sqrt(192)) * 2.0**exponents
    low, high = block.estimates(q, 0)
    assert np.abs((low + high) / 2 - plain).max() < 0.05 * (high - low).min()
    assert ((low <= v @ q) & (v @ q <= high)).mean() > 0.99


def test_repeated_keys_and_ties_take_one_place_each(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 16)
    rows = [(0, [1.0, 0.0])] + [(7, [5.0, 1.0 + i]) for i in range(60)] + [(i, [1.0, float(i % 3)]) for i in range(30, 70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(spark, df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(7, 5.0)] + [(i, 1.0) for i in range(30, 49)]


# -- audio


def tune(rng, n, rate=2048, note=128):
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (p / 12) * np.arange(note) / rate) for p in rng.integers(0, 24, n)])


def test_a_noisy_excerpt_aligns_at_its_offset(spark):
    rng = np.random.default_rng(0)
    a = tune(rng, 200)
    b = np.concatenate([tune(rng, 30), a[3000:12000] + 0.2 * rng.standard_normal(9000), tune(rng, 20)])
    rows = [(0, a), (1, b), *[(i, tune(rng, 64)) for i in range(2, 30)]]
    pcm = lambda x: (x / np.abs(x).max() * 30000).astype("<i2").tobytes()
    data = [(i, pcm(x), 2048) for i, x in rows] + [(40, None, 2048), (41, b"\0" * 9000, None), (42, b"\1", 2048), (None, pcm(a), 2048)]
    df = spark.createDataFrame(data, "rec_id long, pcm binary, rate int").withColumn("n_ints", F.lit(1))
    got = {r["rec_id"]: r for r in audio.scan(spark, df, F.col("rec_id") < 3).collect()}
    assert (got[0]["best_id"], got[1]["best_id"], got[0]["n_matches"], got[2]["n_matches"], got[5]["n_matches"]) == (1, 0, 1, 0, None)
    assert abs(got[1]["best_offset"] - (3000 - 30 * 128) / 64) <= 1 and got[1]["best_error"] <= audio.ERROR and len(got) == 34
    assert got[40]["n_ints"] == 0 and audio.scan(spark, df.limit(0), F.lit(True)).count() == 0


def test_integral_image_filters_equal_plain_sums():
    chroma = np.random.default_rng(1).random((40, 12)).astype(np.float32)
    got = audio.fingerprint(chroma)
    for t in (0, 7, 24):
        value = 0
        for kind, y, h, w in audio.filters():
            x = chroma[t : t + w, y : y + h].astype(float)
            a = (x[:, : h // 2], x[: w // 2], None, x[:, h // 4 : h - h // 4], x[w // 4 : w - w // 4])[kind]
            a = x[: w // 2, : h // 2].sum() + x[w // 2 :, h // 2 :].sum() if kind == 2 else a.sum()
            ratio = math.log((1 + a) / (1 + x.sum() - a))
            level = (ratio > -0.15) + (ratio > 0) + (ratio > 0.15)
            value = value << 2 | (level ^ level >> 1)
        assert int(got[t]) == value
    assert audio.bit_error(got, got, 0) == (0.0, 25) and audio.bit_error(got, got[:0], 0)[1] == 0


# -- licenses


def brute_licenses(text, templates, percent=80):
    w = licenses.template_words(text or "")
    s = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    out = []
    for name, t in templates.items():
        x = licenses.template_words(t)
        x = {tuple(x[i : i + 3]) for i in range(len(x) - 2)}
        n = licenses._size_class(len(licenses.template_words(t)) - 2)
        if x and any(100 * len(x & set(s[i : i + n])) >= percent * len(x) for i in range(0, max(len(s), 1), n // 2)):
            out.append(name)
    return sorted(out)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(f"z{rng.randrange(300)}" for _ in range(n))
    texts = ["", None, "MIT", "Released under the MIT License.", fill(3000)]
    for t in licenses.TEMPLATES.values():
        for _ in range(3):
            w = t.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(f"{fill(rng.randrange(90))} {' '.join(w)} {fill(rng.randrange(90))}".upper() if rng.random() < 0.3 else f"{fill(rng.randrange(90))}\n{' '.join(w)}\n{fill(9)}")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], "x")], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: list(r["licenses"]) for r in licenses.scan(spark, df).collect()}
    assert got == {i: brute_licenses(t, licenses.TEMPLATES) for i, t in enumerate(texts)} | {None: ["MIT"]}
    assert licenses.scan(spark, df.limit(0)).count() == 0
    assert not any("Python" in x or "Arrow" in x for x in licenses.scan(spark, df)._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split())


def test_bands_collide_at_the_least_likeness():
    for n in range(1, 200):
        length = licenses._size_class(n)
        likeness = 0.8 * n / (length + 0.2 * n)
        assert length >= 2 * n and 1 - (1 - likeness) ** licenses.BANDS > 0.9999


# -- quality


def test_ordinal_thresholds_and_held_out_accuracy():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 6)).astype(np.float32)
    w = np.array([2, -1, 0.5, 0, 0, 0])
    score = x @ w + rng.logistic(size=1500)
    grade = (score > -1).astype(int) + (score > 1.5)
    m = quality.fit_ordinal(x[:1000], grade[:1000], 3)
    assert m.thresholds[0] < m.thresholds[1] and abs(m.thresholds[0] + 1) < 0.4 and abs(m.thresholds[1] - 1.5) < 0.4
    tails = m.tails(x[1000:])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails[:, 0] > 0.5) == (grade[1000:] >= 1)).mean() > 0.75
    empty = quality.fit_ordinal(x[:0], grade[:0], 3)
    assert np.isfinite(empty.thresholds).all()


def test_the_gradient_is_the_likelihoods():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((200, 3)).astype(np.float32), rng.integers(0, 4, 200)
    best = quality.fit_ordinal(x, y, 4, rounds=1500)

    def loss(w, th):
        f = x @ w
        p = np.concatenate([np.zeros((200, 1)), 1 / (1 + np.exp(f[:, None] - th[None])), np.ones((200, 1))], axis=1)
        return -np.log(np.diff(p, axis=1)[np.arange(200), y]).mean()

    at = loss(best.weights, best.thresholds)
    for _ in range(50):
        assert loss(best.weights + 0.05 * rng.standard_normal(3), np.sort(best.thresholds + 0.05 * rng.standard_normal(3))) > at - 1e-4


def test_grades_of_documents(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, rated = [], []
    for i in range(240):
        good = i % 3 > 0
        rows.append((i, " ".join(word() if good else word().upper() + "!!" for _ in range(30)), "x"))
        rated.append((i, 0 if not good else 1 + (i % 3 == 2)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "abc", "x"), (902, "word " * 60000, "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tails string")
    labels = spark.createDataFrame(rated + [(1, None), (2, 9), (7777, 0)], "doc_id long, grade int")
    m = quality.fit(spark, docs.where("doc_id < 150"), labels, 3)
    got = quality.grade_documents(docs, m).collect()
    assert len(got) == len(rows)
    right = [r["kept"] == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and 150 <= r["doc_id"] < 240]
    assert np.mean(right) > 0.95 and all(0 <= r["expected_grade"] <= 2 for r in got)
    kept = quality.keep_documents(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.grade_documents(docs.limit(0), m).count() == 0
    assert np.isfinite(quality.fit(spark, docs, labels.limit(0), 3).thresholds).all()


# -- toxicity


def test_grammar_composes_negation_report_and_target():
    m = toxicity.ToxicityModel({"moro": 4.0}, {"scum": 3.0})
    plain = m.clause("the moron went home")
    assert plain == 4.0 and m.clause("nice day") == 0.0
    assert m.clause("you are a moron") > plain and m.clause("what a moron you are") > plain
    assert m.clause("he is not a moron") < plain and m.clause("she said the moron went home") < plain
    assert m.clause("i will kill you") > m.clause("you kill time") > m.clause("to kill time") > 0
    assert m.clause("no moron said the scum") < m.clause("moron scum")


def test_patterns_of_several_words():
    m = toxicity.ToxicityModel({"moro": 4.0}, {})
    assert m.clause("i will make you pay") > 0 and m.clause("we make them all suffer") > 0
    assert m.clause("you pay the bill") == m.clause("make a good soup and pay") == m.clause("they suffer") == 0
    assert m.clause("you piece of trash") > m.clause("a piece of trash") > 0
    assert m.clause("take out the trash") == m.clause("a piece of cake") == m.clause("piece the trash of") == 0
    assert 0 < m.clause("she said i will make you pay") < m.clause("i will make you pay")
    assert 0 < m.clause("he is no piece of trash") < m.clause("he is a piece of trash")
    # the prefilter lets them through
    import pyarrow as pa

    got = toxicity.clause_features(pa.RecordBatch.from_arrays([pa.array(["I will make you PAY.", "Trash is taken out", "a sack of filth"])], ["text"]), m)
    assert got[0, 1] > 0 and got[1, 1] == 0 and got[2, 1] > 0
    assert len(pickle.dumps(m)) < 1_000_000


def test_composition_is_one_machine_after_the_other():
    f = toxicity.Transducer({(0, "a"): (1, "b", 0.5), (1, "a"): (0, "a", 2.0)})
    g = toxicity.Transducer({("s", "b"): ("t", "c", 3.0)}, "s")
    both = toxicity.compose(f, g, "ab")
    rng = random.Random(0)
    for _ in range(200):
        s, sf, sg = both.start, f.start, g.start
        for x in (rng.choice("ab") for _ in range(12)):
            s, out, w = both.step(s, x)
            sf, mid, wf = f.step(sf, x)
            sg, end, wg = g.step(sg, mid)
            assert (out, w, s) == (end, wf * wg, (sf, sg))


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ba", "de", "fi", "go", "lu", "ma"]) for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["Idiotic", "idiots", "SCUM", "wüstling", "Über-ekel".split("-")[1]])
        rows.append((i, " ".join(w) + ".", "en"))
        labels.append((i, int(i % 6 == 0)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "idiots", "x"), (1002, "ba " * 50000 + "idiots", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + [(3, None), (4, 7)], "doc_id long, toxic int")
    m = toxicity.fit(spark, docs, table.where(~toxicity.held_out()))
    got = toxicity.score_toxicity(docs, m).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 40 and np.mean([r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held]) > 0.97
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), m).count() == 0
    assert toxicity.fit(spark, docs, table.limit(0)).stems == {}


def test_the_prefilter_equals_scoring_every_clause():
    import pyarrow as pa

    m = toxicity.ToxicityModel({"idio": 4.0, "über": 3.0}, {"scum": 3.0, "ox": 2.5, "q": 2.0, "éà": 2.0, "rat": 2.0})
    words = ["idiot", "IDIOTS", "scum", "ox", "OX", "oxen", "q", "rat", "ratio", "kill", "\u212aill", "éÀ", "ÜBERall", "dÉtruire", "nice", "été", "you", "日本", "l'idiot"]
    marks = [" ", "¡", "«", "»", "“", "”", "’", "—", "\xa0", "3", "_", "'", ". ", "! ", "\n", ";", "é", "  "]
    rng = random.Random(4)
    texts = ["¡idiota!", "«idiot»", "“idiot”", "—idiot", "\xa0scum", "an ox", "q", "", None, "ox", "en"]
    texts += ["".join(rng.choice(marks) + rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    got = toxicity.clause_features(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), m)
    for t, row in zip(texts, got, strict=True):
        scores = [s for c in re.split("[.!?;\n]+", t or "") if (s := m.clause(c))]
        want = [1, math.log1p(sum(scores)), math.log1p(max(scores)), math.log1p(1000 * len(scores) / len(t.encode()))] if scores else [1, 0, 0, 0]
        assert row == pytest.approx(want), t
    assert (got[:8, 1] > 0).sum() == 7


# -- packing


def brute_buckets(lengths, k):
    from itertools import combinations

    values = sorted(set(lengths))
    return min(sum(min(b for b in (*c, values[-1]) if b >= x) for x in lengths) for r in range(min(k, len(values))) for c in combinations(values[:-1], r))


def test_boundaries_are_optimal():
    rng = random.Random(0)
    for _ in range(60):
        x = [rng.choice([1, 2, 3, 5, 8, 20, 50, 90]) + rng.randrange(3) for _ in range(rng.randint(1, 25))]
        values, counts = np.unique(x, return_counts=True)
        for k in (1, 2, 3, 4):
            b = packing.optimal_boundaries(values.astype(float), counts, k)
            assert len(b) <= k and b == sorted(b) and b[-1] == max(x)
            assert sum(min(y for y in b if y >= v) for v in x) == brute_buckets(x, k)


def test_batches_hold_every_row_once_within_budget(spark):
    rng = random.Random(3)
    rows = [(i, "a " * rng.choice([3, 4, 9, 30, 200]), "x") for i in range(200)] + [(7, "a a", "x"), (None, "a a a", "x"), (300, None, "x"), (301, " ", "x"), (302, "a " * 5000, "x")]
    rows += [(None, "a a a", "x")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string").repartition(5)
    got = packing.pack(spark, df, packing.word_count("text"), buckets=3, budget=400).toPandas()
    live = got[got.n_tokens > 0]
    assert len(got) == len(rows) and len(live) == len(rows) - 2 and got[got.n_tokens == 0].bucket.isna().all()
    assert (live.padding == live.bucket_tokens - live.n_tokens).all() and (live.padding >= 0).all()
    for (_, _), g in live.groupby(["bucket", "batch"]):
        assert len(g) == 1 or g.bucket_tokens.sum() <= 400
        assert sorted(g.slot) == list(range(len(g)))
    for _, g in live.groupby("bucket"):
        size = g.groupby("batch").size()
        assert (size.sort_index().iloc[:-1] == max(1, 400 // int(g.bucket_tokens.iloc[0]))).all() and sorted(size.index) == list(range(len(size)))
    assert packing.pack(spark, df.limit(0), packing.word_count("text")).count() == 0


def test_long_texts_are_packed_with_the_least_padding(spark):
    """Lengths over 1,024, many of them within a hundredth of each other."""
    rng = random.Random(5)
    x = [rng.choice([700, 1100, 1500, 2300]) + rng.randrange(14) for _ in range(40)]
    x = [v for v in x for _ in range(rng.choice([1, 1, 6]))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "doc_id long, n long")
    for k in (2, 4):
        got = packing.pack(spark, df, F.col("n"), buckets=k).toPandas()
        assert got.padding.sum() == brute_buckets(x, k) - sum(x)


# -- pieces


def tiny(bpe):
    def number(n):
        out = b""
        while True:
            out += bytes([(n & 127) | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    part = lambda f, b: number(f << 3 | 2) + number(len(b)) + b
    rng = random.Random(2)
    found = sorted({"▁" * rng.randrange(2) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)} | set("▁ab"))
    vocabulary = [("<unk>", 0.0, 2), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], *[(p, -float(rng.randint(1, 40)), 1) for p in found]]
    out = b"".join(part(1, part(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + number(3 << 3) + number(k)) for p, s, k in vocabulary)
    return pieces.PieceModel.load(out + part(2, number(3 << 3) + number(2 if bpe else 1)) + part(3, number(3 << 3) + number(1) + number(4 << 3) + number(0)))


def best_score(m, word):
    score = {p: s for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k == 1}
    best = [0.0] + [-math.inf] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            best[e] = max(best[e], best[s] + score.get(word[s:e], m.low if e == s + 1 else -math.inf))
    return best[-1]


def by_merging(m, word):
    score = {p: s for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k == 1}
    parts = list(word)
    while True:
        pairs = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in score]
        if not pairs:
            return parts
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("way", ["viterbi", "merges"])
def test_words_equal_brute_force(way):
    m, rng = tiny(way == "merges"), random.Random(0)
    words = ["▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["▁" + "ab" * 60, "▁" + "dab" * 40]
    for word, (raw,) in zip(words, m.encode_words(words, (way,)), strict=True):
        ids = np.frombuffer(raw, np.int32)
        assert b"".join(m.out_bytes[m.out_start[i] : m.out_start[i] + m.out_size[i]].tobytes() for i in ids).decode() == word.replace("▁", " ")
        if way == "merges":
            assert len(ids) == sum(1 if x in m.pieces else len(x.encode()) for x in by_merging(m, word))
        else:
            total, d = 0.0, 0
            for i in ids:
                total += m.low if m.kinds[i] == pieces.BYTE else m.scores[i]
                d += m.kinds[i] == pieces.BYTE
            assert total == pytest.approx(best_score(m, word))


def test_documents_round_trip(spark):
    m = tiny(False)
    texts = ["abc abc  cab", "", None, " a ", "é日\n本", "abca " * 3000, "a" * 700]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "ab", "x")], "doc_id long, text string, ids string")
    rows = pieces.encode_documents(df, m)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(rows, m).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} | {None: "ab"}
    d = {r["doc_id"]: r for r in pieces.digest_documents(df, m).collect()}
    assert all(r["viterbi_round_trip"] and r["merges_round_trip"] for r in d.values()) and d[1]["viterbi_tokens"] == d[2]["merges_tokens"] == 0
    assert pieces.encode_documents(df.limit(0), m).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="the public vocabulary is not here")
def test_merges_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        m = pieces.PieceModel.load(f.read())
    rng = random.Random(0)
    texts = ["  Hello  world\nfoo ", "", "a", "é日本🎉 x", "\tindent  twice", "q" * 300, "ab" * 200] + ["".join(rng.choice("etaoin shrdlu,.é\n") for _ in range(200)) for _ in range(100)]
    got = [np.frombuffer(x, np.int32).tolist() for (x,) in pieces.Encoder(m, ("merges",)).encode(texts)]
    assert got == library.encode(texts)


def test_short_texts_make_small_blocks():
    import pyarrow as pa

    texts = ["", None, "a b", "x" * 4000] * 600
    blocks = list(quality.features(pa.record_batch([pa.array(texts)], ["text"])))
    assert max(map(len, blocks)) <= quality.ROWS and sum(map(len, blocks)) == len(texts)
    one = next(quality.features(pa.record_batch([pa.array(texts[:4])], ["text"])))
    assert all(np.allclose(b[:4], one) for b in blocks)
