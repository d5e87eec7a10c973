from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecue.llm import line_dedup, near_dedup, substring_dedup
from tidecue.llm.components import connected_components

from .conftest import SCHEMA, WORD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and low[b] < low[a]:
                    low[a], changed = low[b], True
    return {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


@pytest.mark.parametrize(("region", "block"), [(12, 1024), (1, 3)])
def test_near_duplicates_equal_brute_force(spark, docs, monkeypatch, region, block):
    monkeypatch.setattr(near_dedup, "REGION", region)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark, docs, k=4).collect()}
    assert got == brute_near([(r["doc_id"], r["text"]) for r in docs.collect()], 4)


def test_a_large_group_of_near_copies_keeps_single_links(spark):
    """Chains of edits: some documents are linked to one other only."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(120), rng.randint(1, 7)):
            w[j] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark, df, k=5).collect()}
    assert got == {i: v[1] for i, v in brute_near(rows, 5).items()}


def test_near_duplicates_edge_cases(spark, none):
    assert near_dedup.near_duplicates(spark, none).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(spark, df).collect())
    assert got == [(0, 3, 0, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True)]
    assert sorted(r["doc_id"] or 0 for r in near_dedup.drop_near_duplicates(spark, df).collect()) == [0, 1, 3]
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    both = spark.createDataFrame([(3, a), (5, a + " more"), (5, b), (7, b), (8, c), (9, c + " too")], "doc_id int, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark, both).collect()) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (9, 8)]


def brute_substrings(rows, k):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {p for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings_equal_brute_force(spark, docs):
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for k in (13, 8):
        got = sorted(tuple(r) for r in substring_dedup.repeated_substrings(spark, docs, window=k).select(cols).collect())
        assert got == brute_substrings([(r["doc_id"], r["text"]) for r in docs.collect()], k)


def test_substrings_edge_cases(spark, none):
    assert substring_dedup.repeated_substrings(spark, none).count() == 0
    p, q = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(14))
    rows = [(5, f"a {p} b {p} c"), (5, q), (7, f"{q} x {p}"), (9, p), (9, p), (None, p), (8, None), (4, "z " * 40), (6, "z " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.repeated_substrings(spark, df).collect())
    assert got == [(0, 20, 0), (4, 40, 0), (5, 14, 0), (5, 43, 0), (6, 30, 30), (7, 35, 34), (8, 0, 0), (9, 20, 20), (9, 20, 20)]
    left = substring_dedup.drop_repeated_substrings(spark, df.withColumn("kept_text", F.lit(1)))
    assert left.columns == ["doc_id", "text", "kept_text"]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.where("doc_id > 5").collect()) == [(6, ""), (7, "x"), (8, ""), (9, ""), (9, "")]


def test_lines_edit_distance(spark):
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(1500):
        a = [rng.randrange(6) for _ in range(rng.randrange(24))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        for most in range(4):
            assert line_dedup.within(x, y, most) == (distance(a, b) <= most)
            if abs(len(a) - len(b)) <= most and len(a) and len(b):
                assert line_dedup._band(x, y, most) == (distance(a, b) <= most)


def brute_lines(rows, least=5):
    """The same definition by comparing all lines with a plain edit distance."""
    found = []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            w = re.findall("[a-z0-9\x80-\U0010ffff]+", line.translate(LOWER))
            if len(w) >= least:
                found.append((i, n, tuple(w)))
    found.sort(key=lambda x: x[:2])
    first = {}
    for x, f in enumerate(found):
        first.setdefault(f[2], x)
    low = {w: x for w, x in first.items()}
    near = [(a, b) for a in first for b in first if a < b and distance(a, b, max(len(a), len(b)) // 10)]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {(f[0], f[1]) for x, f in enumerate(found) if low[f[2]] != x}


def distance(a, b, most):
    """Whether the edit distance is at most ``most``, by the full table."""
    if abs(len(a) - len(b)) > most or (most == 0 and a != b) or sum((Counter(a) - Counter(b)).values()) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


@pytest.mark.parametrize(("bucket", "block"), [(16, 1024), (1, 2)])
def test_lines_equal_brute_force(spark, docs, monkeypatch, bucket, block):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    got = {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(spark, docs).collect()}
    assert got == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()]) and got


def test_lines_in_texts(spark, none):
    assert line_dedup.count_repeated_lines(spark, none).count() == 0
    line = "the quick brown foxes jumped over"
    rows = [(1, f"{line}\nshort one\n{line}!"), (2, f"new line of some words\n{line.upper()}.\n\nshort one"), (2, None), (3, ""), (None, line)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone int")
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in line_dedup.drop_repeated_lines(spark, df).collect())
    assert left == [(0, line), (1, f"{line}\nshort one"), (2, ""), (2, "new line of some words\n\nshort one"), (3, "")]
    counts = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in line_dedup.count_repeated_lines(spark, df).collect())
    assert counts == [(0, 1, 0), (1, 3, 1), (2, 0, 0), (2, 4, 1), (3, 0, 0)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == low
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_extra_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", "x", "y", 3)], SCHEMA).withColumn("component_id", F.lit(7))
    assert near_dedup.drop_near_duplicates(spark, df).columns == df.columns
    assert line_dedup.drop_repeated_lines(spark, df).columns == df.columns


def test_all_lines_within_the_edit_bound_are_linked(spark, monkeypatch):
    """Brute-force edit similarity alone decides: no sketch, no hash distance."""
    rng = random.Random(6)
    word = lambda: f"{rng.choice('abcdefg')}{rng.randrange(3000)}"
    rows = []
    for n in [9, 10, 11, 14, 19, 20, 21, 29, 30, 33, 45, 60, 100, 230] * 6:
        line = [word() for _ in range(n)]
        rows.append(line)
        for most in (1, n // 10, n // 10, n // 10 + 1):
            new = list(line)
            for _ in range(most):
                at = rng.randrange(len(new))
                new[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(2))]
            rows.append(new)
    rows += [["a"] * 40, ["a"] * 44, ["a"] * 50, ["a", "b"] * 20, ["a", "b"] * 21]
    code = {w: i for i, w in enumerate({w for r in rows for w in r})}
    code = [np.array([code[w] for w in r], np.uint64) for r in rows]
    low = list(range(len(rows)))
    links = [(a, b) for b in range(len(rows)) for a in range(b) if line_dedup.within(code[a], code[b], max(len(rows[a]), len(rows[b])) // 10)]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    want = {i for i, x in enumerate(low) if x != i}
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    assert len(want) > 150
    for bucket, block in ((16, 1024), (1, 2)):
        monkeypatch.setattr(line_dedup, "BUCKET", bucket)
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        assert {r["doc_id"] for r in line_dedup.repeated_lines(spark, df).collect()} == want


def test_the_query_drops_short_repeats(spark, tmp_path):
    from tidecue.llm import queries

    rows = [(1, "All rights reserved.\nhello", "en", "s", 26), (2, "hello there\n\nall rights reserved\n!!", "en", "s", 36), (3, "Hello", "en", "s", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_repeated_lines(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"]) for r in got) == [(1, 2, 0), (2, 4, 1), (3, 1, 1)]


def test_a_hot_bucket_links_across_ranges_and_blocks(spark, monkeypatch):
    """Lines that share a run of words: chains of edits, and others that are alike to none."""
    monkeypatch.setattr(line_dedup, "BUCKET", 2)
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(9)]
    line = common + [f"w{i}" for i in range(31)]
    rows = []
    for i in range(60):
        line = list(line)
        for _ in range(3):
            line[rng.randrange(9, 40)] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(line)))
    rows += [(100 + i, " ".join(common + [f"y{rng.randrange(900)}" for _ in range(rng.randint(12, 40))])) for i in range(40)]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(spark, df).collect()}
    assert got == brute_lines(rows) and len(got) > 40


def test_columns_of_any_name_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = ["_gone", "__gone", "_of", "_tag", "_mark", "_kept", "__tag", "__kept", "__of", "digest", "spans", "node"]
    df = spark.createDataFrame([(1, text), (2, text + "\nmore words that stay here alone")], "doc_id long, text string")
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for drop in (line_dedup.drop_repeated_lines, near_dedup.drop_near_duplicates, substring_dedup.drop_repeated_substrings):
        out = drop(spark, df)
        assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(names)))}
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(spark, df).collect()}
    assert left == {1: text, 2: "more words that stay here alone"}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_substrings(spark, df).collect()}
    assert left == {1: text, 2: "more words that stay here alone"}


def test_intermediate_tables_go(spark, docs):
    """What is left after an operator is what its result still reads; ``clean`` deletes that too."""
    from tidecue.llm import _store

    def tables():
        home = _store._home(spark).removeprefix("file://")
        return set(os.listdir(home)) if os.path.isdir(home) else set()

    _store.clean(spark)
    for run in (near_dedup.near_duplicates, line_dedup.repeated_lines, substring_dedup.repeated_substrings):
        run(spark, docs).count()
        assert not {x.split("-")[0] for x in tables()} & {"survey", "edges", "sources", "seeds", "shared", "marks", "buckets", "words", "sets", "regions", "pairs", "deep", "apart", "large", "linked"}
        _store.clean(spark)
        assert not tables()


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tidecue.llm import _store

    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            _store.shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf))
