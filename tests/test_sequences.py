"""Alignment, gaps, windows and fallback places against plain loops over lists, on random episodes."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidecue.operators import align, blocks, lookup, subtitles, timeline

LINE = "episode_id string, line_idx int, start double, end double, en string, words array<struct<s:double,e:double>>"


def bag(text):
    return {w for w in re.findall("[a-z']+", (text or "").lower()) if len(w) > 1}


@pytest.mark.parametrize(("levels", "cells"), [((8, 3, 1), 0), ((3, 1), 40), ((8, 3, 1), 1 << 18), ((1,), 0)])
def test_blocks_equal_the_plain_recurrence(spark, levels, cells):
    rng, want, a, b = random.Random(len(levels) * 1000 + cells), set(), [], []
    for key in range(500):
        letters = ["no", "yes", "the", "go", "ha"][: rng.randint(1, 5)] if key % 3 else [f"w{i}" for i in range(30)]
        x = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        y = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        if key % 4 == 0 and x:
            at = rng.randrange(len(x))
            y[len(y) // 2 : len(y) // 2] = x[at : at + 15]
        a += [(key, i, w) for i, w in enumerate(x)]
        b += [(key, i, w) for i, w in enumerate(y)]
        want |= {(key, i + k, j + k) for i, j, n in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for k in range(n)}
    table = lambda rows: spark.createDataFrame(rows, "key int, pos int, word string")
    got = blocks.matching_blocks(table(a), table(b), levels, cells).collect()
    cells_of = [(r["key"], r["alo"] + k, r["blo"] + k) for r in got for k in range(r["ahi"] - r["alo"])]
    assert len(cells_of) == len(set(cells_of)) and set(cells_of) == want


def test_long_sequences_are_sorted_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(blocks, "STRETCH", 16)
    rng = random.Random(4)
    x = [f"w{rng.randrange(60)}" for _ in range(700)]
    y = x[50:300] + [f"w{rng.randrange(60)}" for _ in range(80)] + x[330:600]
    table = lambda v: spark.createDataFrame([("e", i, w) for i, w in enumerate(v)], "key string, pos int, word string")
    got = {(r["alo"] + k, r["blo"] + k) for r in blocks.matching_blocks(table(x), table(y), cells=2000).collect() for k in range(r["ahi"] - r["alo"])}
    assert got == {(i + k, j + k) for i, j, n in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for k in range(n)}


def test_matches_carry_lines_and_times(spark):
    heard = spark.createDataFrame([("e", 3, 1.0, 3.0, "Good morning, dear", None), ("e", 5, 4.0, 5.0, "", None), ("e", 9, 6.0, 7.0, "friend", [(6.1, 6.4)]), ("x", 0, 0.0, 1.0, "alone here", None)], LINE)
    script = spark.createDataFrame([("e", 0, "good morning"), ("e", 2, "my dear friend"), ("e", 4, None)], "episode_id string, sidx int, text string")
    got = sorted((r["line_idx"], r["sidx"], round(r["s"], 3), round(r["e"], 3)) for r in align.word_matches(heard, script).collect())
    assert got == [(3, 0, 1.0, 1.667), (3, 0, 1.667, 2.333), (3, 2, 2.333, 3.0), (9, 2, 6.1, 6.4)]
    assert align.word_matches(heard.limit(0), script).count() == 0


def filled_by_a_loop(heard, known, said):
    """Line by line: what is taken counts for the lines after it."""
    out = list(known)
    for i, text in enumerate(heard):
        if out[i] is not None:
            continue
        prev = next((x for x in reversed(out[:i]) if x is not None), None)
        after = next((x for x in out[i + 1 :] if x is not None), None)
        window = [j for j in range(len(said)) if j >= (prev or 0) and (after is None or j <= after)]
        like = {j: (len(bag(text) & bag(said[j])) / len(bag(text) | bag(said[j])) if bag(text) and bag(said[j]) else 0.0) for j in window}
        order = sorted(window, key=lambda j: (like[j], j), reverse=True)
        if not order:
            continue
        second = like[order[1]] if len(order) > 1 else 0.0
        if like[order[0]] >= 0.30 and like[order[0]] >= second + 0.10:
            out[i] = order[0]
        elif prev is not None and after is not None and after - prev in (0, 2):
            out[i] = (prev + after) // 2
    return out


def test_gaps_fill_as_a_loop_would(spark):
    rng = random.Random(7)
    words = ["sun", "moon", "star", "sky", "sea", "don't", "a", "run"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    lines, script, want = [], [], set()
    for e in range(120):
        said = [sentence() for _ in range(rng.randint(1, 12))]
        heard = [rng.choice(said) if rng.random() < 0.5 else sentence() for _ in range(rng.randint(1, 14))]
        known = [rng.randrange(len(said)) if rng.random() < 0.3 else None for _ in heard]
        if e % 2:  # in order, as matches mostly are
            at = sorted(x for x in known if x is not None)
            known = [at.pop(0) if x is not None else None for x in known]
        lines += [(str(e), i, t, k) for i, (t, k) in enumerate(zip(heard, known, strict=True))]
        script += [(str(e), j, t) for j, t in enumerate(said)]
        want |= {(str(e), i, x) for i, x in enumerate(filled_by_a_loop(heard, known, said))}
    lines += [("none", 0, "sun moon", None)]
    want.add(("none", 0, None))
    got = align.fill_gaps(spark.createDataFrame(lines, "episode_id string, line_idx int, en string, sidx int"), spark.createDataFrame(script, "episode_id string, sidx int, text string"))
    assert {tuple(r) for r in got.collect()} == want


def window_by_a_loop(o, w, following, total, quiet, speech):
    if speech:
        far = max([w] + [e for s, e in speech if e > o and s < w + 0.4])
        w = max(w, min(far, following))
    for s, e in quiet:
        o = e if s - 1e-6 <= o < e else o
        w = s if s < w <= e + 1e-6 else w
    w = max(next((s for s, _ in quiet if o < s < w), w), o + 0.3)
    ended = [i for i, (_, e) in enumerate(quiet) if e > o + 1e-6]
    first = ended[0] if ended else len(quiet)
    return o, w, quiet[first - 1][1] if first else 0.0, next((s for s, _ in quiet if s >= w - 1e-6), total)


@pytest.mark.parametrize("cell", [600.0, 5.0])
def test_windows_as_a_loop_would(spark, monkeypatch, cell):
    monkeypatch.setattr(lookup.asof, "__kwdefaults__", lookup.asof.__kwdefaults__ | {"cell": cell})
    monkeypatch.setattr(lookup.running_most, "__kwdefaults__", lookup.running_most.__kwdefaults__ | {"cell": cell})
    rng, lines, quiet, speech, totals, want = random.Random(int(cell)), [], [], [], [], {}
    for e in range(60):
        at = lambda: round(rng.uniform(0, 40) * 2) / 2 if e % 2 else round(rng.uniform(0, 40), 3)  # noqa: B023, E731
        raw = sorted((x := at(), x + round(rng.uniform(0.3, 4), 1)) for _ in range(rng.randint(1, 8)))
        q = sorted({(s := at(), s + round(rng.uniform(0.1, 6), 1)) for _ in range(rng.randint(0, 9))} if e % 5 else set())
        sp = sorted((s := at(), s + round(rng.uniform(0.1, 8), 1)) for _ in range(rng.randint(0, 5) if e % 3 else 0))
        lines += [(str(e), i, s, x, "", None) for i, (s, x) in enumerate(raw)]
        quiet += [(str(e), *x) for x in q]
        speech += [(str(e), *x) for x in sp]
        totals.append((str(e), 50.0))
        for i, (o, w) in enumerate(raw):
            want[str(e), i] = window_by_a_loop(o, max(w, o + 0.3), raw[i + 1][0] if i + 1 < len(raw) else 50.0, 50.0, q, sp)
    table = lambda rows: spark.createDataFrame(rows, "episode_id string, s double, e double")
    got = timeline.line_windows(spark.createDataFrame(lines, LINE), table(quiet), spark.createDataFrame(totals, "episode_id string, total double"), table(speech)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[2:] == pytest.approx(want[r["episode_id"], r["line_idx"]], abs=6e-5), (r, want[r["episode_id"], r["line_idx"]])


def placed_by_a_loop(lines, placed, quiet, total):
    """(line, start, end, text) of (line, sidx, start, end, text) lines."""
    out, groups = [], {}
    for line, j, start, end, text in lines:
        if j is None or not placed:
            if text:
                out.append((line, start, max(end, start + 1.0), text))
            continue
        groups.setdefault((max((a for a in placed if a < j), default=None), min((a for a in placed if a >= j), default=None)), []).append((j, line, text))
    for (before, behind), members in groups.items():
        lo = placed[before][1] + 0.12 if before is not None else 0.0
        hi = placed[behind][0] - 0.12 if behind is not None else total
        hi = lo + len(members) if hi <= lo else hi
        inner = [(min(e, hi) - max(s, lo), -max(s, lo), min(e, hi)) for s, e in quiet if min(e, hi) > max(s, lo)]
        if inner and max(inner)[0] >= 0.4:
            _, lo, hi = max(inner)
            lo = -lo
        slot = max(hi - lo, 0.0) / len(members)
        for k, (_, line, text) in enumerate(sorted(members)):
            st = lo + k * slot
            want = max(1.0, min(3.5, len(text) / 4.6)) if text else 1.0
            out.append((line, st, max(st + min(want, max(slot - 0.12, 1.0)), st + 1.0), text))
    return out


def test_fallbacks_are_placed_as_a_loop_would(spark, monkeypatch):
    monkeypatch.setattr(subtitles, "NUMBERS", 4.0)
    rng, script, placed, quiet, want = random.Random(3), [], [], [], {}
    for e in range(40):
        anchors = {} if e % 7 == 0 else {j: (s := round(rng.uniform(0, 60), 2), s + round(rng.uniform(0.2, 3), 2)) for j in rng.sample(range(30), rng.randint(1, 6))}
        lines = [(i, rng.choice([None, *range(30)]), float(i), i + 0.5, rng.choice(["", "你好", "a longer text of several words"])) for i in range(rng.randint(0, 14))]
        q = [(s := round(rng.uniform(0, 60), 2), s + round(rng.uniform(0.1, 9), 2)) for _ in range(rng.randint(0, 5))]
        script += [(str(e), *x, "", True) for x in lines] + [(str(e), 99, 1, 0.0, 1.0, "voiced", "", False)]
        placed += [(str(e), j, *x) for j, x in anchors.items()]
        quiet += [(str(e), *x) for x in q]
        want[str(e)] = placed_by_a_loop(lines, anchors, q, 70.0)
    got = subtitles.place_fallbacks(
        spark.createDataFrame(script, "episode_id string, line_idx int, sidx int, start double, end double, zh string, en string, fallback boolean"),
        spark.createDataFrame(placed, "episode_id string, sidx int, p0 double, p1 double"), spark.createDataFrame(quiet, "episode_id string, s double, e double"),
        spark.createDataFrame([(str(e), 70.0) for e in range(40)], "episode_id string, total double"),
    ).collect()
    assert len(got) == sum(map(len, want.values()))
    for e, rows in want.items():
        mine = sorted((r["line_idx"], r["start"], r["end"], r["zh"]) for r in got if r["episode_id"] == e)
        for a, b in zip(mine, sorted(rows), strict=True):
            assert (a[0], a[3]) == (b[0], b[3]) and a[1:3] == pytest.approx(b[1:3], abs=6e-4)


def test_script_order(spark):
    rows = [("e", 5.0, 1), ("e", 5.0, None), ("e", 1.0, 9), ("e", 700.0, 0), ("e", None, 3), ("f", 2.0, 0)]
    got = subtitles.script_order(spark.createDataFrame(rows, "episode_id string, start double, sidx int").withColumn("line_idx", F.lit(0))).collect()
    assert sorted((r["episode_id"], r["line_idx"], r["start"], r["sidx"]) for r in got) == [("e", 0, 1.0, 9), ("e", 1, 5.0, 1), ("e", 2, 5.0, None), ("e", 3, 700.0, 0), ("e", 4, None, 3), ("f", 0, 2.0, 0)]
