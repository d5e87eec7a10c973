from __future__ import annotations

import pytest

from tidecue.operators import providers
from tidecue.plans import settings


def test_settings_merge_and_resolve(tmp_path):
    p = tmp_path / "a/s.json"
    assert settings.load(p) == {}
    settings.save(p, a=1)
    settings.save_of_profile(p, "x", cast={"Ann": "v"})
    settings.save_of_profile(p, "x", more=2)
    assert settings.load(p)["a"] == 1 and settings.of_profile(p, "x") == {"cast": {"Ann": "v"}, "more": 2} and settings.of_profile(p, "y") == {}
    settings.save(p, KEY="f")
    assert settings.resolve("KEY", " ", p, {}) == ("f", "file")
    assert settings.resolve("KEY", "", p, {"KEY": "e"}) == ("e", "environment")
    assert settings.resolve("KEY", "g", p, {"KEY": "e"}) == ("g", "given") and settings.resolve("NO", "", p, {}) == ("", "")
    p.write_text("[")
    assert settings.load(p) == {}


def test_model_replies_and_pages():
    class Model:
        said = ["sorry", "here: {\"a\": 1} ok"]

        def reply(self, system, user):
            return self.said.pop(0)

    waits = []
    assert providers.json_reply(Model(), "", "", sleep=waits.append) == {"a": 1} and waits == [1.0]

    def page(n):
        if n == 3:
            raise OSError
        return [{"n": n}]

    assert providers.harvest(page) == [{"n": 1}, {"n": 2}]
    with pytest.raises(ValueError):
        providers.retry(lambda: int("x"), 2, 0.0)
    assert providers.provider("fake").check() and providers.fitted(None, b"x", 1.005) == b"x"


def test_listed_voices(spark):
    df = spark.createDataFrame([(0, "a", "新闻女声", "", None), (1, "b", "male reader", "asmr", ["zh"]), (2, "c", "boy", "", ["zh-CN"]), (3, "d", "girl", "", ["en"]), (4, "e", "robot", "", ["zh"])], "pos int, voice string, title string, description string, languages array<string>")
    assert [tuple(r) for r in providers.voice_candidates(df).orderBy("pos").collect()] == [(0, "FEMALE", "a"), (2, "MALE", "c")]


def test_files_and_pages(tmp_path):
    import hashlib
    from email.message import Message

    body = b"abc" * 1000
    key = hashlib.sha256(body).hexdigest()
    asked = []
    bring = lambda b: lambda: asked.append(1) or [b[:7], b[7:]]
    with pytest.raises(ValueError):
        providers.verified_file(tmp_path / "m/a.bin", key, bring(b"other"))
    assert not list((tmp_path / "m").iterdir())
    for _ in range(2):
        assert providers.file_key(providers.verified_file(tmp_path / "m/a.bin", key, bring(body))) == key
    assert len(asked) == 2
    assert providers.first_font([("/nowhere", "A"), (str(tmp_path), "B")]) == (str(tmp_path), "B") and providers.first_font([]) is None

    class Answer:
        headers = Message()

        def __init__(self, status):
            self.status = status

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return "né".encode()

    codes, waits = [500, 404, 200], []
    assert providers.read_page("u", opened=lambda url, timeout: Answer(codes.pop(0)), sleep=waits.append) == "né" and waits == [1.0, 2.0]


def test_clips_are_reused_and_a_dead_service_ends_the_run(spark):
    cols = "episode_id string, line_idx int, zh string, voice string, emo string, backup string, provider string"
    lines = spark.createDataFrame([("e", i, f"t{i}", "own", "[sad]" if i % 2 else "", "bak", "fake") for i in range(12)], cols)
    made = spark.createDataFrame([("e", 1, "t1|own||fake", b"1"), ("e", 3, "t3|bak|[sad]|fake", b"3"), ("e", 5, "old|own||fake", b"5"), ("e", 7, "t7|own||other", b"7"), ("e", 9, "t9|own||fake", None)], "episode_id string, line_idx int, stamp string, clip binary")
    assert [(r["line_idx"], bytes(r["clip"])) for r in providers.reusable_clips(lines, made).orderBy("line_idx").collect()] == [(1, b"1"), (3, b"3")]
    keep = lambda df: df.checkpoint()
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    got = providers.synthesize_rest(lines, made, lambda: providers.FakeSpeech(frozenset({"own"})), keep).orderBy("line_idx").collect()
    assert [r["line_idx"] for r in got] == list(range(12)) and [r["line_idx"] for r in got if not r["used_backup"]] == [1, 3]
    dead = lambda: providers.FakeSpeech(frozenset({"own", "bak"}))
    with pytest.raises(RuntimeError):
        providers.synthesize_rest(lines, made, dead, keep)
    few = providers.synthesize_rest(lines.where("line_idx < 4"), made, dead, keep).orderBy("line_idx").collect()
    assert [r["clip"] is None for r in few] == [True, False, True, False]


def test_search_hits_and_genders(spark):
    df = spark.createDataFrame([(i, f"v{i}", "girl " + "x" * 70 if i % 2 else "robot", "a\nb" if i else "asmr", ["en", "zh"]) for i in range(40)], "pos int, voice string, title string, description string, languages array<string>")
    got = providers.search_hits(df).collect()
    assert [r["pos"] for r in got] == list(range(1, 26)) and got[0]["gender"] == "FEMALE" and got[1]["gender"] == "?" and len(got[0]["title"]) == 60 and got[0]["description"] == "a b" and got[0]["languages"] == "en,zh"

    class Model:
        def reply(self, system, user):
            self.user = user
            return '{"genders": {"n0": "MALE", "n1": "unsure"}}'

    model = Model()
    assert providers.ask_genders(model, [f"n{i}" for i in range(70)]) == {"n0": "MALE"} and model.user.count(",") == 59


def test_script_is_kept_and_an_edited_one_goes_first(spark, tmp_path):
    from tidecue.plans import dub, stages
    from tidecue.sources.profiles import Profile

    root, parts, built = f"file://{tmp_path}", dub.script_parts("m", Profile("Show", ())), []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        script, edited = stages.script_once(spark, root, parts, build)
        assert script.count() == 3 and not edited
    stages.save_edited(script.where("id > 0"), root, parts)
    script, edited = stages.script_once(spark, root, parts, build)
    assert script.count() == 2 and edited and built == [1]
    stages.save_edited(script.where("id > 1"), root, parts)
    assert stages.script_once(spark, root, parts, build)[0].count() == 1
    (tmp_path / "a.srt").write_text("x")
    one, two = (stages.stage_copy(spark, f"file://{tmp_path}/a.srt", f"{root}/out") for _ in range(2))
    assert one != two and one.endswith("/a.srt") and spark.read.text(one).first()[0] == "x"


def test_pitch_of_padded_lines(spark):
    import numpy as np

    from tidecue.operators import voices

    rate = 8000
    t = np.arange(rate) / rate
    track = np.concatenate([np.sin(2 * np.pi * 110 * t), np.zeros(rate), np.sin(2 * np.pi * 220 * t)])
    tracks = spark.createDataFrame([("e", track.tolist()), ("none", [])], "episode_id string, samples array<float>")
    lines = spark.createDataFrame([("e", 0, 0.0, 1.0), ("e", 1, 1.2, 1.8), ("e", 2, 2.0, 9.0), ("e", 3, 2.5, 2.6), ("lost", 0, 0.0, 1.0)], "episode_id string, line_idx int, start double, end double")
    got = voices.line_genders(voices.heard_pitches(lines, tracks, rate))
    assert {(r["episode_id"], r["line_idx"]): r["gender"] for r in got.collect()} == {("e", 0): "MALE", ("e", 1): "", ("e", 2): "FEMALE", ("e", 3): "FEMALE", ("lost", 0): ""}


def test_few_lines_are_not_clustered(spark):
    from tidecue.operators import voices

    prints = spark.createDataFrame([(e, i, w, [1.0]) for e, n in (("a", 8), ("b", 7)) for i in range(n) for w in (0, 1)], "episode_id string, line_idx int, win_idx int, embedding array<float>")
    assert {r[0] for r in voices.enough_lines(prints).select("episode_id").distinct().collect()} == {"a"}
