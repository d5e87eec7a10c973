"""Alignment and gap filling without a row for each word."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from tidecue.operators import align
from tidecue.plans import sequences

HEARD, SCRIPT = "episode_id string, line_idx int, start double, end double, en string, words array<struct<s:double,e:double>>", "episode_id string, sidx int, text string"


def test_words_of_small_episodes_become_no_rows(spark, monkeypatch):
    rng = random.Random(6)
    said = lambda n: " ".join(rng.choice(("sun", "moon", "star", "sky", "sea")) for _ in range(n))
    sizes = {"a": 6, "b": 40, "c": 0, "d": 3}
    heard = [(e, 10 * k, float(k), k + 1.0, said(rng.randint(0, 4)) if n else "", None) for e, n in sizes.items() for k in range(n)] + [("only", 0, 0.0, 1.0, "sun", None)]
    script = [(e, k, said(rng.randint(0, 4))) for e, n in sizes.items() for k in range(n + 1)]
    want = {}
    for e in sizes:
        a, b = [(k, t, w) for x, k, _, _, en, _ in heard if x == e for t, w in enumerate(en.split())], [(k, w) for x, k, text in script if x == e for w in text.split()]
        blocks = SequenceMatcher(None, [x[2] for x in a], [x[1] for x in b], autojunk=False).get_matching_blocks()
        want[e] = [(e, a[i + k][0], b[j + k][0]) for i, j, n in blocks for k in range(n)]
    placed, plain = [], align.positions
    monkeypatch.setattr(align, "positions", lambda lines, key, *more: placed.append({r[0] for r in lines.select(key).collect()}) or plain(lines, key, *more))
    h, s = spark.createDataFrame(heard, HEARD), spark.createDataFrame(script, SCRIPT)
    for cells, large in ((1 << 18, []), (900, [{"b"}, {"b"}])):
        placed.clear()
        got = sorted((r["episode_id"], r["line_idx"], r["sidx"]) for r in align.word_matches(h, s, cells=cells).collect())
        assert got == sorted(x for w in want.values() for x in w)
        assert placed == large


def test_words_of_short_runs_become_no_rows(spark, monkeypatch):
    rng = random.Random(8)
    said = lambda: " ".join(rng.choice(("sun", "moon", "star", "sky", "sea", "fog", "run")) for _ in range(rng.randint(0, 5)))
    script = [(e, k, said()) for e in ("a", "b") for k in range(30)]
    lines = [(e, k, said(), k if rng.random() < (0.5 if e == "a" else 0.1) else None) for e in ("a", "b", "none") for k in range(30)]
    tables = spark.createDataFrame(lines, "episode_id string, line_idx int, en string, sidx int"), spark.createDataFrame(script, SCRIPT)
    got = {}
    for short in (1000, 20, 0):
        monkeypatch.setattr(align, "SHORT", short, raising=False)
        filled = align.fill_gaps(*tables)
        got[short] = sorted(map(tuple, filled.collect()), key=str)
        by_word = "explode(words" in filled._jdf.queryExecution().toString()
        assert by_word == (short in (20, 0))
    assert len({str(x) for x in got.values()}) == 1 and len(got) == 3


def test_episodes_in_rows_fill_like_tables_of_lines(spark):
    rng = random.Random(9)
    said = lambda: " ".join(rng.choice(("sun", "moon", "star", "sky", "sea", "fog", "run")) for _ in range(rng.randint(0, 5)))
    rows = [(str(e), [(10 * k, said(), rng.choice((rng.randint(0, 9), None, None))) for k in range(rng.randint(0, 14))], [said() for _ in range(rng.randint(1, 12))] if e % 7 else None) for e in range(60)]
    rows += [("empty", [(0, "sun", None), (1, "sun", 0), (2, None, None)], []), ("far", [(0, "sun", 40), (1, "sun", None), (2, "sun", 0)], ["sun", "moon"])]
    words = lambda text: text if text is None else text.split()
    split = [(e, [(k, words(en), sidx) for k, en, sidx in heard], texts and [words(x) for x in texts]) for e, heard, texts in rows]
    filled = align.fill_whole(spark.createDataFrame(split, "episode_id string, heard array<struct<line_idx:int,words:array<string>,sidx:int>>, script array<array<string>>"))
    assert "Exchange" not in filled._jdf.queryExecution().executedPlan().toString()
    lines, script = [(e, *x) for e, heard, _ in rows for x in heard], [(e, j, x) for e, _, texts in rows for j, x in enumerate(texts or [])]
    want = align.fill_gaps(spark.createDataFrame(lines, "episode_id string, line_idx int, en string, sidx int"), spark.createDataFrame(script, SCRIPT))
    assert sorted(map(tuple, filled.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_only_the_texts_of_filled_gaps_are_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, "The sun rose. A cold moon. It set\nagain"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    filled = sequences.filled_gaps(spark, str(tmp_path))
    assert filled._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r["episode_id"], r["line_idx"]) for r in filled.collect()) == [("1", 0), ("1", 1), ("1", 2), ("1", 3), ("2", 0)]
