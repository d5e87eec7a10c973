from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tidecue.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    seen, count, sources = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        seen.update((lang, t) for t in set(terms))
    out = []
    for lang, names in sources.items():
        kept = [t for (x, t), n in seen.items() if x == lang and n >= least]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[t] for t in kept) + 2 * v) for t in kept}
        p = {s: share(count[lang, s]) for s in names}
        q = share(sum((count[lang, s] for s in names), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in names if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(rows, 1)]
    return sorted(out)


def run(spark, docs, **kw):
    table = spark.createDataFrame([(t, x, s, "p", 1, "z") for x, s, t in docs], "text string, lang string, source string, term string, n int, z string").repartition(3)
    return sorted(map(tuple, D.source_divergence(spark, table, **kw).collect()))


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "Thé", "x9y", "[", "the", "of", "日本", "É", "q", "zz", "rare", "one-two", "\x7f"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(4) for j in range(8)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 40)))
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "S3", "é", None]), text()) for _ in range(n)]
    return docs + [("en", "empty", None), ("xx", "only", "a b"), ("xx", "other", ""), *[("en", "s1", "the same words")] * 7, ("de", "long", "the of q " * 4000)]


@pytest.mark.parametrize("least", [1, 4, 10])
def test_equals_brute_force(spark, least):
    docs = made(least)
    assert run(spark, docs, min_docs=least, terms=5) == brute(docs, least, 5)


def test_groups_beyond_the_limit_are_joined(spark, monkeypatch):
    docs = made(9, 60)
    monkeypatch.setattr(D, "GROUPS", 0)
    assert run(spark, docs, min_docs=2, terms=3) == brute(docs, 2, 3)


@pytest.mark.parametrize("docs", [[], [("en", "a", None)], [("en", "a", "x"), ("en", None, "x"), (None, None, None)]])
def test_small_tables(spark, docs):
    assert run(spark, docs) == brute(docs, 10, 10)


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(D._share(F.lit(9 * 10**17), F.lit(10**18), F.lit(10**6)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (9 * 10**17 + 2) // (10**18 + 2 * 10**6)
