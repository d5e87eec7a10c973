from __future__ import annotations

import hashlib
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecue.operators import align, attribute, identify, lookup, mix, pitch, providers, segments, subtitles, timeline, translate, vad, voices
from tidecue.sources.profiles import Character, Profile

SHOW = Profile("Show", (Character("Alice", (), "F"), Character("Bob", (), "M")), skip_intro_seconds=1.0, theme_words=("sun", "moon", "star"))
WORDS = "array<struct<s:double,e:double>>"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_credible_and_repeats(spark):
    x = spark.createDataFrame([("e", i, t, p, c, a) for i, (t, p, c, a) in enumerate([("hi", 0.1, 1.0, 0.0), (" ", 0.0, 1.0, 0.0), ("um", 0.9, 1.0, 0.0), ("la", 0.1, 3.0, -0.9), ("hi", None, None, None), ("hi", 0.0, 1.0, 0.0), ("yo", 0.0, 1.0, 0.0), ("hi", 0.0, 1.0, 0.0)])], "episode_id string, line_idx int, en string, no_speech_prob double, compression_ratio double, avg_logprob double")
    kept = segments.drop_repeats(segments.credible(x))
    assert [r[1] for r in rows(kept.select("episode_id", "line_idx"), "line_idx")] == [0, 4, 6, 7]


def test_monotone_times_carry_the_corrected_end(spark):
    x = spark.createDataFrame([("e", 0, 0.0, 2.0), ("e", 1, 1.0, 1.5), ("e", 2, 2.1, 3.0), ("f", 0, 0.0, 1.0)], "episode_id string, line_idx int, start double, end double")
    assert rows(segments.monotone_times(x).select("episode_id", "line_idx", "start", "end"), "episode_id", "line_idx") == [("e", 0, 0.0, 2.0), ("e", 1, 2.0, 2.3), ("e", 2, 2.3, 3.0), ("f", 0, 0.0, 1.0)]


def test_split_merged(spark):
    w = [(float(i), i + 0.5) for i in range(4)]
    x = spark.createDataFrame([("e", 0, 0.0, 4.0, "- Abcd. - Efgh?", w), ("e", 1, 4.0, 6.0, "- One. - Two.", None), ("e", 2, 6.0, 7.0, "-  just one", [])], f"episode_id string, line_idx int, start double, end double, en string, words {WORDS}")
    got = rows(segments.split_merged(x).select("line_idx", "part", "start", "end", "en", F.size("words")), "line_idx", "part")
    assert got == [(0, 0, 0.0, 1.5, "Abcd.", 2), (0, 1, 2.0, 3.5, "Efgh?", 2), (1, 0, 4.0, 5.0, "One.", 0), (1, 1, 5.0, 6.0, "Two.", 0), (2, 0, 6.0, 7.0, "just one", 0)]


def test_utterances_join_until_punctuation_gap_or_length(spark):
    x = [(0.0, 1.0, "so I"), (1.1, 2.0, "went home."), (2.1, 3.0, "Then"), (4.0, 5.0, "slept"), (5.1, 12.5, "long"), (12.6, 13.5, "over")]
    df = spark.createDataFrame([("e", i, s, e, t, None) for i, (s, e, t) in enumerate(x)], f"episode_id string, line_idx int, start double, end double, en string, words {WORDS}")
    assert [r[2:5] for r in rows(segments.merge_utterances(df), "line_idx")] == [(0.0, 2.0, "so I went home."), (2.1, 3.0, "Then"), (4.0, 5.0, "slept"), (5.1, 12.5, "long"), (12.6, 13.5, "over")]


def test_identify_ranks_ties_and_misses(spark):
    t = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "seven eight nine ten"), ("d", None)], "episode_id string, text string")
    h = spark.createDataFrame([("x", "one two three four"), ("y", "zip zap zop"), ("z", "no")], "heard_id string, en string")
    assert rows(identify.identify(h, t), "heard_id") == [("x", "a", 1.0, 1.0, True, False), ("y", "a", 0.0, 0.0, False, False)]


def _plan(lines, total):
    """The planner as a recurrence."""
    order = sorted(lines, key=lambda x: (x[1], x[0]))
    end = [0.0] * len(order)
    for k in reversed(range(len(order))):
        end[k] = total if k == len(order) - 1 else min(order[k + 1][1] + 4.0, end[k + 1] - order[k + 1][2] / 1.6) - 0.12
    out, free = {}, 0.0
    for (i, onset, dur), limit in zip(order, end, strict=True):
        place = max(onset, free)
        tempo = 1.0 if limit - place >= dur - 1e-9 else round(min(dur / max(limit - place, 0.3), 1.6), 4)
        out[i], free = (place, tempo, dur), place + dur / tempo + 0.12
    return out


def test_planner_on_random_scenes(spark):
    rng, scenes = random.Random(1234), []
    for scene in range(500):
        t, lines = 0.0, []
        for i in range(rng.randint(1, 10)):
            t += rng.uniform(0.05, 3.0)
            lines.append((i, t, rng.uniform(0.3, 4.0)))
            t += rng.uniform(0.4, 2.5)
        scenes.append((f"s{scene}", lines, t + 2.0))
    df = spark.createDataFrame([(s, i, o, d, total) for s, lines, total in scenes for i, o, d in lines], "episode_id string, line_idx int, onset double, dur double, total double")
    got = {}
    for s, i, place, tempo in rows(timeline.plan_timeline(df).select("episode_id", "line_idx", "place", "tempo")):
        got.setdefault(s, {})[i] = (place, tempo)
    for s, lines, total in scenes:
        want, last = _plan(lines, total), -1.0
        for i, onset, dur in sorted(lines, key=lambda x: x[1]):
            place, tempo = got[s][i]
            assert place == pytest.approx(want[i][0], abs=2e-4) and tempo == pytest.approx(want[i][1], abs=2e-4)
            assert 1.0 <= tempo <= 1.6 and place >= onset - 1e-3 and place >= last - 1e-3
            last = place + dur / tempo + 0.12


def test_silences_speech_and_short_runs(spark):
    r = spark.createDataFrame([("e", 1.0, 2.0), ("e", 1.5, 1.8), ("e", 2.2, 3.0), ("e", 5.0, 6.0)], "episode_id string, s double, e double")
    t = spark.createDataFrame([("e", 7.0), ("f", 1.0)], "episode_id string, total double")
    quiet = vad.silences(r, t)
    assert rows(quiet, "episode_id", "s") == [("e", 0.0, 1.0), ("e", 3.0, 5.0), ("e", 6.0, 7.0), ("f", 0.0, 1.0)]
    assert rows(vad.speech(quiet, t), "s") == [("e", 1.0, 3.0), ("e", 5.0, 6.0)]
    m = spark.createDataFrame([("e", i, c == "1") for i, c in enumerate("1101110011")], "episode_id string, frame_idx int, mask boolean")
    flip = lambda v, k: "".join("01"[r[2]] for r in rows(vad.flip_short_runs(m, v, k), "frame_idx"))
    assert (flip(False, 2), flip(False, 3), flip(True, 3), flip(False, 1)) == ("1111110011", "1111111111", "0001110000", "1101110011")


def test_energy_map_finds_the_pause(spark):
    power = [0.1] * 100 + [1e-8] * 50 + [0.1] * 100
    f = spark.createDataFrame([("e", i, p) for i, p in enumerate(power)] + [("g", i, 0.5) for i in range(50)], "episode_id string, frame_idx int, power double")
    ((e, s, t),) = rows(vad.energy_silences(f))
    assert e == "e" and abs(s - 2.0) < 0.05 and abs(t - 3.0) < 0.05


def test_alignment_is_the_common_order(spark):
    heard = [("e", 0, 0.0, 1.0, "hello there my friend", None), ("e", 1, 1.0, 2.0, "garbage noise words", None), ("e", 2, 2.0, 3.0, "how are you today", [(2.0, 2.4), (2.4, 2.9)])]
    script = [("e", 0, "Alice", "Hello there, my dear friend!"), ("e", 1, "Bob", "Fine weather."), ("e", 2, "Alice", "And how are you today?")]
    h = spark.createDataFrame(heard, f"episode_id string, line_idx int, start double, end double, en string, words {WORDS}")
    s = spark.createDataFrame(script, "episode_id string, sidx int, speaker string, text string")
    m = align.word_matches(h, s).cache()
    a, b = [w for r in heard for w in r[4].split()], "hello there my dear friend fine weather and how are you today".split()
    assert m.count() == sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert rows(align.best_lines(m, h), "line_idx") == [("e", 0, 0), ("e", 2, 2)]
    assert [(r[1], r[4]) for r in rows(align.anchored_spans(m, s), "sidx")] == [(0, 4), (2, 4)]
    lines, _ = align.align(h, s)
    assert [(r["line_idx"], r["sidx"], r["raw"]) for r in lines.orderBy("line_idx").collect()] == [(0, 0, "Alice"), (1, 1, "Bob"), (2, 2, "Alice")]


def test_neighbours_fill_as_a_loop_would(spark):
    rng, cases = random.Random(5), []
    for c in range(300):
        t, x = 0.0, []
        for i in range(rng.randint(1, 8)):
            t += rng.choice([0.1, 0.5, 1.0])
            x.append((f"c{c}", i, t, t + 0.3, rng.choice([None, None, "A", "B", "Skip"]), rng.choice(["OtherMale", "OtherFemale"])))
            t += 0.3
        cases.append(x)
    df = spark.createDataFrame([r for x in cases for r in x], "episode_id string, line_idx int, start double, end double, label string, guest string")
    got = {(r["episode_id"], r["line_idx"]): r["label"] for r in attribute.fill_by_neighbour(df).collect()}
    for x in cases:
        label = [r[4] for r in x]
        for i in range(len(x)):
            if label[i] is None:
                p = label[i - 1] if i else None
                n = next((y for y in label[i + 1 :] if y), None)
                near = (x[i][2] - x[i - 1][3] if i else 9e9) <= (x[i + 1][2] - x[i][3] if i + 1 < len(x) else 9e9)
                label[i] = p if p and near else n or p or x[i][5]
        assert [got[r[0], r[1]] for r in x] == label


def test_casting(spark):
    data = [(0, 0.5, "intro", None, 0, ""), (1, 2.0, "hi", "ALICE", 1, "FEMALE"), (2, 3.0, "yo", "Everyone", 1, "FEMALE"), (3, 4.0, "sun moon star shine", None, None, ""), (4, 5.0, "hm", "carl", 2, "MALE"), (5, 6.0, "eh", None, None, "")]
    df = spark.createDataFrame([("e", i, s, s + 0.5, en, raw, c, g) for i, s, en, raw, c, g in data], "episode_id string, line_idx int, start double, end double, en string, raw string, cluster int, gender string")
    out = attribute.cast_speakers(df, SHOW)
    assert [r["label"] for r in out.orderBy("line_idx").collect()] == ["Skip", "Alice", "Alice", "Skip", "Carl", "Carl"]
    five = spark.createDataFrame([("e", i, float(i) + 1, i + 1.5, "x", "Bob" if i < 4 else "carl", 0, "MALE") for i in range(5)], df.schema)
    assert {r["label"] for r in attribute.cast_speakers(five, SHOW).collect()} == {"Bob"}
    assert rows(attribute.cluster_majority(five.withColumn("label", F.lit("Bob")))) and attribute.cast_tally(out).count() == 3


def test_majority_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("k", 3, "a"), ("k", 4, "b")], "k string, n int, v string")
    assert rows(attribute.majority(df, ["k"], "v", "n")) == [("k", "b", 2, 4)]


def test_script_lines_merge_split_and_bridge(spark):
    def go(*x):
        df = spark.createDataFrame([("e", i, s, e, en, None, k, t, lab) for i, (s, e, en, k, t, lab) in enumerate(x)], f"episode_id string, line_idx int, start double, end double, en string, words {WORDS}, sidx int, stext string, label string")
        return [(r["start"], r["end"], r["en"], r["fragments"]) for r in timeline.merge_by_script_line(df).orderBy("line_idx").collect()]

    full = "well hello my friend"
    assert go((0.0, 1.0, "well hello", 3, full, "A"), (1.3, 2.0, "my friend", 3, full, "A")) == [(0.0, 2.0, full, 2)]
    assert go((0.0, 1.0, "well hello", 3, full, "A"), (8.0, 9.0, "my friend", 3, full, "A")) == [(0.0, 1.0, "well hello", 1), (8.0, 9.0, "my friend", 1)]
    assert go((0.0, 1.0, "well", 3, full, "A"), (1.5, 2.0, "zzz qqq", None, None, "A"), (2.5, 3.0, "friend", 3, full, "A")) == [(0.0, 3.0, "well zzz qqq friend", 3)]
    assert go((0.0, 1.0, "well", 3, full, "A"), (1.2, 2.0, "hello", 3, full, "B")) == [(0.0, 1.0, "well", 1), (1.2, 2.0, "hello", 1)]


def test_windows_speech_and_silences(spark):
    lines = [("e", 0, 1.0, 2.0, [(1.0, 1.2), (1.3, 1.6)]), ("e", 1, 3.0, 9.0, [(3.0, 3.5), (7.7, 8.0)]), ("e", 2, 10.0, 10.1, None)]
    df = spark.createDataFrame(lines, f"episode_id string, line_idx int, start double, end double, words {WORDS}")
    t = spark.createDataFrame([("e", 12.0)], "episode_id string, total double")
    sil = spark.createDataFrame([("e", 0.0, 0.9), ("e", 2.2, 2.9), ("e", 4.0, 7.0)], "episode_id string, s double, e double")
    reg = spark.createDataFrame([("e", 0.9, 2.2), ("e", 2.9, 4.0), ("e", 7.0, 12.0)], "episode_id string, s double, e double")
    got = rows(timeline.line_windows(df, sil, t, reg), "line_idx")
    assert got == [("e", 0, 1.0, 2.2, 0.9, 2.2), ("e", 1, 3.0, 4.0, 2.9, 4.0), ("e", 2, 10.0, 12.0, 7.0, 12.0)]
    assert rows(timeline.line_windows(df, sil.where("false"), t), "line_idx")[0] == ("e", 0, 1.0, 1.6, 0.0, 12.0)


def test_missing_lines_and_fallback_subtitles(spark):
    script = spark.createDataFrame([("e", 0, 0, 0.0, 1.0, "one", "Alice", "", ""), ("e", 1, 2, 5.0, 6.0, "three", "Alice", "", "")], "episode_id string, line_idx int, sidx int, start double, end double, en string, speaker string, zh string, emo string").withColumns({"words": F.array().cast(WORDS), "fallback": F.lit(False)})
    lines = spark.createDataFrame([("e", i, "Bob", f"text number {i}") for i in range(3)] + [("f", i, "Bob", "x") for i in range(20)], "episode_id string, sidx int, speaker string, text string")
    spans = spark.createDataFrame([("e", 0, 0.0, 1.0)], "episode_id string, sidx int, onset double, end double")
    both = subtitles.insert_missing(script, lines, spans, SHOW)
    assert [(r["line_idx"], r["sidx"], r["start"], r["end"], r["fallback"]) for r in both.orderBy("line_idx").collect()] == [(0, 0, 0.0, 1.0, False), (1, 1, 2.0, 4.0, True), (2, 2, 5.0, 6.0, False)]
    placed = spark.createDataFrame([("e", 0, 0, 0.0, 1.0, "甲"), ("e", 2, 2, 5.0, 6.0, "乙")], "episode_id string, line_idx int, sidx int, start double, end double, zh string")
    sil = spark.createDataFrame([("e", 2.0, 4.0)], "episode_id string, s double, e double")
    t = spark.createDataFrame([("e", 10.0)], "episode_id string, total double")
    free = subtitles.place_fallbacks(both, subtitles.placed_by_sidx(placed), sil, t).drop("line_idx")
    ((_, s, e, zh),) = rows(free)
    assert zh == "text number 1" and s == 2.0 and e == pytest.approx(3.88)
    table = subtitles.subtitle_table(placed, free, subtitles.retained(both, placed.limit(1)))
    assert [r["seq"] for r in table.orderBy("seq").collect()] == [0, 1, 2, 3]
    cue = subtitles.srt_cues(table).orderBy("n").first()["cue"]
    assert cue == "1\n00:00:00,000 --> 00:00:01,000\n甲\n"


def test_srt_files(spark, tmp_path):
    x = spark.createDataFrame([("e", 0, 0.0, 1.0, "甲"), ("f", 0, 2.0, 2.1, "乙" * 40)], "episode_id string, seq int, start double, end double, zh string")
    subtitles.write_srt(x, str(tmp_path / "srt"))
    text = spark.read.text(str(tmp_path / "srt"), wholetext=True).where("episode_id = 'f'").first()[0]
    assert text.count("-->") == 2 and "00:00:02,000 --> 00:00:02,200" in text


def test_reuse_prefers_the_line_then_the_only_text(spark):
    old = spark.createDataFrame([("e", "f1", 0, 5, "What?", "什么", "a"), ("e", "f1", 1, 6, "What?", "啥", "b"), ("e", "f2", 0, 7, "Home.", "家", None)], "episode_id string, file string, pos int, sidx int, en string, zh string, emo string")
    new = spark.createDataFrame([("e", 0, 5, "What?", "A", "", ""), ("e", 1, 9, "What?", "A", "", ""), ("e", 2, 1, "Home. ", "A", "", ""), ("e", 3, 7, "Home.", "Skip", "", ""), ("e", 4, 7, "Home.", "A", "有", "")], "episode_id string, line_idx int, sidx int, en string, speaker string, zh string, emo string")
    assert [(r["zh"], r["emo"]) for r in translate.reuse_translations(new, old).orderBy("line_idx").collect()] == [("什么", "a"), ("", ""), ("家", ""), ("", ""), ("有", "")]


def test_translation_shrinks_batches(spark):
    x = spark.createDataFrame([("e", i, float(i), i + 1.0, "A" if i else "Skip", f"line {i}", "", "") for i in range(20)], "episode_id string, line_idx int, start double, end double, speaker string, en string, zh string, emo string")

    def ask(batch):
        return {r["line_idx"]: {"zh": f"译{r['line_idx']}", "emo": ""} for r in batch if len(batch) <= 4 or r["line_idx"] % 3}

    out = translate.translate(spark, x, ask)
    assert [r["zh"] for r in out.orderBy("line_idx").collect()] == [""] + [f"译{i}" for i in range(1, 20)]
    assert translate.with_context(x).orderBy("line_idx").collect()[2]["context"] == "Skip: line 0\nA: line 1"


def test_review_edits(spark):
    x = spark.createDataFrame([("e", 0, 1.0, "Alice", "hi", "嗨"), ("e", 1, 2.0, "Bob", "yo", "哟")], "episode_id string, line_idx int, start double, speaker string, en string, zh string")
    table = translate.review_rows(x)
    assert rows(table, "idx")[0] == ("e", 0, "1.00", "Alice", "hi", "嗨")
    edits = spark.createDataFrame([("e", 0, "skip", ""), ("e", 1, "nobody", " 你好 "), ("e", 9, "Bob", "x")], "episode_id string, idx int, speaker string, zh string")
    got = translate.apply_review(x, edits, SHOW.labels)
    assert [(r["speaker"], r["zh"]) for r in got.orderBy("line_idx").collect()] == [("Skip", ""), ("Bob", "你好")]


def test_pitch_and_gender(spark):
    t = np.arange(int(1.5 * 16000)) / 16000
    for hz, want in ((110, "MALE"), (225, "FEMALE")):
        f0 = voices.frame_pitches(np.sin(2 * np.pi * hz * t), 16000)
        assert len(f0) > 50 and abs(np.median(f0) - hz) < 5
        df = spark.createDataFrame([("e", float(x)) for x in f0], "k string, f0 double")
        assert rows(voices.gender_by_pitch(df, ["k"])) == [("e", want)]
    assert len(voices.frame_pitches(np.zeros(8000), 16000)) == 0 and voices.median_pitch(np.zeros(100), 16000) is None


def test_three_voices_are_told_apart(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((3, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    data, truth = [], {}
    for i in range(60):
        truth[i] = i % 3
        for w in range(2):
            v = centres[i % 3] + 0.5 * rng.standard_normal(64) / 8
            data.append(("e", i, w, (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame(data, "episode_id string, line_idx int, win_idx int, embedding array<double>")
    got = {r["line_idx"]: r["cluster"] for r in voices.line_clusters(voices.cluster_windows(df)).collect()}
    pure = sum(max(sum(truth[i] == k for i in truth if got[i] == c) for k in range(3)) for c in set(got.values()))
    assert len(set(got.values())) == 3 and pure / 60 >= 0.95


def test_voice_maps_and_guests(spark):
    cast = spark.createDataFrame([("Alice", "v1")], "speaker string, voice string")
    pool = spark.createDataFrame([("FEMALE", "v1", 0, 0), ("FEMALE", "v2", 1, 0), ("FEMALE", "v3", 0, 1)], "gender string, voice string, source int, pos int")
    assert dict(rows(voices.voice_map(cast, pool))) == {"Alice": "v1", "OtherMale": "v3", "OtherFemale": "v3"}
    assert dict(rows(voices.voice_map(cast, pool.limit(0)))) == {"Alice": "v1", "OtherMale": "", "OtherFemale": ""}
    text = "M " + "a1" * 12 + "\n# F " + "b" * 24 + "\n女 学生 " + "c" * 24 + "\nx " + "d" * 24 + "\nF short"
    parsed = voices.parse_guest_pool(spark.createDataFrame([(text,)], "text string"))
    assert [r[1:] for r in rows(parsed, "pos")] == [("MALE", "a1" * 12), ("FEMALE", "c" * 24)]


def served_by_a_loop(names, known, pool, reserved, genders, f0, generic):
    """One guest after the other, by name; what one takes, the next ones do not get."""
    out = {n: v for n, v in known.items() if f0.get(v) is None or f0[v] <= 300}
    taken = set(out.values())
    for name in sorted({n for n in names if n and n != "Skip"} - set(out)):
        woman = (genders.get(name) or ("FEMALE" if name.lower().endswith(("a", "ie", "y", "elle", "ine")) else "MALE")) == "FEMALE"
        lists = [[v for _, _, v in sorted((s, p, v) for g, v, s, p in pool if g == of)] for of in (("FEMALE", "MALE") if woman else ("MALE", "FEMALE"))]
        fit = [v for v in lists[0] or lists[1] if v not in reserved and (f0.get(v) is None or f0[v] <= 300)]
        open_ = [v for v in fit if v not in taken] or fit
        pick = open_[int(hashlib.sha1(name.encode()).hexdigest(), 16) % len(open_)] if open_ else generic.get("OtherFemale" if woman else "OtherMale", "")
        if pick:
            out[name] = pick
            taken.add(pick)
    return out


def test_guests_are_served_as_in_a_row(spark):
    rng, want, tables = random.Random(8), set(), {k: [] for k in ("names", "pool", "known", "reserved", "genders", "generic")}
    people = ["Dora", "Emma", "Skip", "", "Zed", "Bo", "Amy", "Ine", "Élan", "Kyle", "Max", "Gus", "Rosie", "Abel"] + [f"Guest {i}" for i in range(30)]
    for show in map(str, range(40)):
        voices_ = [f"v{i}" for i in range(rng.randint(0, 12))]
        pool = [(rng.choice(["MALE", "FEMALE"] if rng.random() < 0.8 else ["MALE"]), v, rng.randint(0, 1), i) for i, v in enumerate(voices_)]
        pool += [("FEMALE", v, 1, 50) for v in voices_[:1] if rng.random() < 0.4]  # the same voice for both
        f0 = {v: rng.choice([None, 200.0, 300.0, 400.0]) for v in voices_}
        names, reserved = rng.sample(people, rng.randint(0, len(people))), {v for v in voices_ if rng.random() < 0.2}
        known = {n: rng.choice(voices_) for n in people[4:9] if voices_ and rng.random() < 0.3}
        genders = {n: rng.choice(["MALE", "FEMALE", ""]) for n in names if rng.random() < 0.4}
        generic = {"OtherMale": "g1", "OtherFemale": rng.choice(["g2", "", *voices_])} if rng.random() < 0.7 else {}
        want |= {(show, *x) for x in served_by_a_loop(names, known, pool, reserved, genders, f0, generic).items()}
        tables["names"] += [(show, n) for n in names]
        tables["pool"] += [(show, *x, f0[x[1]]) for x in pool]
        tables["known"] += [(show, *x) for x in known.items()]
        tables["reserved"] += [(show, v) for v in reserved]
        tables["genders"] += [(show, *x) for x in genders.items()]
        tables["generic"] += [(show, *x) for x in generic.items()]
    schemas = {"names": "speaker string", "pool": "gender string, voice string, source int, pos int, f0 double", "known": "speaker string, voice string", "reserved": "voice string", "genders": "speaker string, gender string", "generic": "speaker string, voice string"}
    frames = {k: spark.createDataFrame(v, f"show string, {schemas[k]}") for k, v in tables.items()}
    got = [tuple(r) for r in voices.guest_voices(**frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert voices.guest_voices(**{k: v.limit(0) for k, v in frames.items()}).count() == 0


def test_clips_try_the_backup_voice(spark):
    x = spark.createDataFrame([("e", 0, "甲", "[sad]", "v1", "v2"), ("e", 1, "乙", "", "bad", "v2"), ("e", 2, "丙", "", "bad", "")], "episode_id string, line_idx int, zh string, emo string, voice string, backup string")
    got = rows(providers.synthesize(x, lambda: providers.FakeSpeech(frozenset({"bad"}))).select("line_idx", F.col("clip").isNotNull(), "used_backup"), "line_idx")
    assert got == [(0, True, False), (1, True, True), (2, False, False)]


def test_mix_ducks_under_clips(spark):
    rate, track = 1000, np.ones(10000, np.float32) * 0.5
    out = mix.duck(track, [(3000, 4000, 0, np.full(1000, 0.2, np.float32))], rate, 0.4)
    assert out[1000] == pytest.approx(0.2, abs=1e-3) and out[3500] == pytest.approx(0.5 * 0.06 + 0.95 * 0.2, abs=1e-3) and np.abs(out).max() <= 1
    # the gain is a moving average, as a convolution has it
    covered = np.full(10000, 0.4)
    covered[2940:4060] = 0.06
    plain = track * np.convolve(covered, np.full(60, 1 / 60), mode="same")
    plain[3000:4000] += 0.95 * 0.2
    assert np.allclose(out, plain, atol=1e-6)


def test_blocks_mix_as_the_whole_track_does(spark):
    rng, rate, a, b, want = np.random.default_rng(2), 400, [], [], {}
    for e in range(12):
        n = int(rng.integers(0, 3000)) if e else 0
        track = rng.uniform(-1, 1, n).astype(np.float32)
        clips = sorted((float(np.round(rng.uniform(0, 8), 3)), k, rng.uniform(-1, 1, int(rng.integers(0, 900))).astype(np.float32)) for k in range(int(rng.integers(0, 6))))
        a.append((str(e), track.tolist()))
        b += [(str(e), k, s, x.tolist()) for s, k, x in clips]
        on = [(int(s * rate), min(int(s * rate) + len(x), n), 0, x) for s, _, x in clips if int(s * rate) < n]
        want[str(e)] = mix.duck(track, on, rate, 0.4)
    tracks = spark.createDataFrame(a, "episode_id string, samples array<float>")
    clips = spark.createDataFrame(b, "episode_id string, clip_idx int, start double, samples array<float>")
    for size in (64, 1000, 1 << 16):
        got = mix.assemble(mix.track_blocks(tracks, size), clips, rate, 0.4, size).orderBy("episode_id", "block").collect()
        for e, whole in want.items():
            mine = np.array([x for r in got if r["episode_id"] == e for x in r["samples"]], np.float32)
            assert mine.tobytes() == whole.tobytes(), (e, size)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    data = [(k, float(x)) for k in range(20) for x in np.round(rng.normal(0, 3, int(rng.integers(1, 60))), 1)] + [(5, None), (99, None)]
    df = spark.createDataFrame(data, "k int, v double")
    for cell in (0.5, 100.0):
        got = {r["k"]: r for r in lookup.exact_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.95, "top": 1.0}, cell=cell).collect()}
        assert set(got) == set(range(20))
        for k, r in got.items():
            v = [x for j, x in data if j == k and x is not None]
            assert r["n"] == len(v) and [r[c] for c in ("a", "m", "z", "top")] == pytest.approx([np.quantile(v, q) for q in (0.1, 0.5, 0.95, 1.0)])


def test_recordings_in_blocks_have_the_pitch_of_the_whole(spark):
    rng, rate, tracks = np.random.default_rng(4), 1600, {}
    for e in range(10):
        n = int(rng.integers(0, 900)) if e else 0
        tracks[str(e)] = (np.where(np.arange(n) % (6 + e) < 3, 0.5, -0.5) + rng.normal(0, 0.3, n)).astype(np.float32)
    tracks["quiet"] = np.zeros(500, np.float32)
    table = spark.createDataFrame([(e, x.tolist()) for e, x in tracks.items()], "episode_id string, samples array<float>")
    for size in (10, 64, 1 << 12):
        got = {r["episode_id"]: r["f0"] for r in pitch.track_pitches(mix.track_blocks(table, size), rate, size).collect()}
        want = {e: voices.median_pitch(x, rate) for e, x in tracks.items()}
        assert set(got) == set(want) and sum(v is not None for v in want.values()) >= 4
        for e, v in want.items():
            assert got[e] == (pytest.approx(v) if v is not None else None), (e, size)
