"""Stages and replies survive writers at the same time, failures and killed runs."""

from __future__ import annotations

import json
import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidecue.operators import translate
from tidecue.plans import dub, stages

SCRIPT = "episode_id string, line_idx int, start double, end double, speaker string, en string, zh string, emo string"


def test_two_writers_get_one_table(spark, tmp_path):
    root, parts, gate, got = str(tmp_path / "s"), {"a": 1}, threading.Barrier(2), {}

    def build(n):
        gate.wait()  # both have seen that nothing is there
        return spark.range(n)

    def write(n):
        got[n] = stages.build_once(spark, root, parts, lambda: build(n)).count()

    writers = [threading.Thread(target=write, args=(n,)) for n in (3, 5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(set(got.values())) == 1 and got[3] in (3, 5)
    home = Path(root) / stages.identity(parts)
    # one table and the manifest are left
    assert len([x for x in home.iterdir() if x.is_dir()]) == 1
    assert stages.build_once(spark, root, parts, lambda: spark.range(9)).count() == got[3]


def test_a_failed_build_leaves_nothing_that_counts(spark, tmp_path):
    root, parts = str(tmp_path / "s"), {"b": 1}
    broken = spark.range(4).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        stages.build_once(spark, root, parts, lambda: broken)
    assert stages.published(spark, f"{root}/{stages.identity(parts)}") is None
    assert stages.build_once(spark, root, parts, lambda: spark.range(2)).count() == 2


def test_readers_keep_what_an_edit_replaces(spark, tmp_path):
    root, parts = str(tmp_path / "s"), {"c": 1}
    stages.save_edited(spark.range(3), root, parts)
    before, edited = stages.script_once(spark, root, parts, lambda: spark.range(0))
    stages.save_edited(before.where("id > 0"), root, parts)
    assert edited and before.count() == 3 and stages.script_once(spark, root, parts, lambda: spark.range(0))[0].count() == 2


def test_speech_and_voices_are_stored_by_media_and_model(spark, tmp_path):
    calls, root = [], str(tmp_path)

    def detect():
        calls.append("speech")
        return spark.createDataFrame([("e", 0.0, 1.0)], "episode_id string, s double, e double")

    assert [dub.stored_regions(spark, root, m, detect, {"least": 0.3}).count() for m in ("m1", "m1", "m2")] == [1, 1, 1] and calls == ["speech"] * 2
    raw = spark.createDataFrame([("e", 0, 0.0, 1.0, "hello there", [(0.0, 0.5)], 0.1, 1.0, 0.0)], "episode_id string, line_idx int, start double, end double, en string, words array<struct<s:double,e:double>>, no_speech_prob double, compression_ratio double, avg_logprob double")

    def listen(lines):
        calls.append("voices")
        return lines.select("episode_id", "line_idx", F.lit(0).alias("cluster"), F.lit("").alias("gender"))

    assert [dub.stored_voices(spark, root, "m1", raw, listen, name).count() for name in ("a", "a", "b")] == [1, 1, 1] and calls.count("voices") == 2


def lines(spark, n=24):
    return spark.createDataFrame([("e", i, float(i), i + 1.0, "A", f"line {i}", "", "") for i in range(n)], SCRIPT)


def asking(home, dies_at=None):
    """A model that notes each call; at one line it takes its process down, once."""

    def ask(batch):
        names = [r["line_idx"] for r in batch]
        if dies_at in names and not (Path(home) / "died").exists():
            (Path(home) / "died").write_text("")
            os._exit(1)
        with (Path(home) / "calls").open("a") as f:
            f.write(json.dumps(names) + "\n")
        return {i: {"zh": f"译{i}", "emo": ""} for i in names}

    return ask


def test_a_killed_pass_asks_only_what_had_no_reply(spark, tmp_path):
    log = str(tmp_path / "log")
    try:
        out = translate.translate(spark, lines(spark), asking(str(tmp_path), dies_at=20), sizes=(4, 1), log=log).collect()
    except Exception:  # noqa: BLE001  where tasks are not tried again, the run ends
        out = translate.translate(spark, lines(spark), asking(str(tmp_path), dies_at=20), sizes=(4, 1), log=log).collect()
    assert (tmp_path / "died").exists() and {r["zh"] for r in out} == {f"译{i}" for i in range(24)}
    calls = (tmp_path / "calls").read_text().splitlines()
    assert len(calls) == len(set(calls)) == 6
    # a whole run again asks nothing
    assert len(translate.translate(spark, lines(spark), asking(str(tmp_path)), sizes=(4, 1), log=log).collect()) == 24
    assert len((tmp_path / "calls").read_text().splitlines()) == 6


def test_reading_a_result_asks_nothing(spark, tmp_path):
    out = translate.translate(spark, lines(spark, 6), asking(str(tmp_path)), sizes=(4, 1))
    assert out.count() == 6 and out.where("zh <> ''").count() == 6
    assert len((tmp_path / "calls").read_text().splitlines()) == 2


def test_a_failed_request_is_not_kept(spark, tmp_path):
    log = translate.ReplyLog(str(tmp_path / "log"))
    request = [{"line_idx": 1, "en": "a"}]
    assert log.get(request) is None
    log.put(request, {1: {"zh": "甲", "emo": ""}})
    assert log.get(request) == {1: {"zh": "甲", "emo": ""}} and log.get([{"line_idx": 2, "en": "a"}]) is None
