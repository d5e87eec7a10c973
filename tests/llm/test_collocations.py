from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tidecue.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, most, least, covered, rows):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in candidates.items():
        inside = any(x == lang and len(v) > len(w) and 100 * b >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in candidates.items())
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, i, p.decode(), -a, left, right, total, -s) for lang, v in out.items() for i, (s, a, p, left, right, total) in enumerate(sorted(v)[:rows], 1))


def run(spark, docs, **kw):
    table = spark.createDataFrame([(t, x, 1, "w", "k") for x, t in docs], "text string, lang string, n int, word string, key string").repartition(3)
    return sorted(map(tuple, C.collocations(spark, table, **kw).collect()))


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = ["a", "B", "the", "of", "été", "日", "x\x00", "x", "x\x01y", "0", "|", "l'an", "\x1c", "z" * 100]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t ", " ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    docs = [(rng.choice(["en", "en", "de", None, "und", "", "a\nb\\n"]), text()) for _ in range(160)]
    docs += [("en", None), (None, ""), ("en", "the of the of " * 40), *[("de", "one two three four five")] * 9, ("en", "a " * 3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 23)
    try:
        for top, least, rows in ((C.TOP, 5, 2000), (3, 4, 7), (0, 30, 2000)):
            monkeypatch.setattr(C, "TOP", top)
            want = brute(docs, 4, least, 80, rows)
            assert want and run(spark, docs, min_count=least, rows=rows) == want
        # prefixes that reach over many ranges
        monkeypatch.setattr(C, "n_parts", lambda _: 40)
        assert run(spark, docs, min_count=6, max_words=3, covered=50) == brute(docs, 3, 6, 50, 2000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("docs", [[], [("en", None)], [(None, "a b")], [("en", "a b. a b " * 3)]])
def test_small_tables(spark, docs):
    assert run(spark, docs, min_count=3) == brute(docs, 4, 3, 80, 2000)


def test_products_beyond_64_bits(spark):
    big = spark.range(1).selectExpr("9000000000000000000L AS a", "9000000000000000000L AS l")
    from pyspark.sql import functions as F

    score = C._div(F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), (F.col("l") + F.lit(0)).cast("decimal(20,0)"))
    assert big.select(score.alias("s")).first()["s"] == 2_000_000
