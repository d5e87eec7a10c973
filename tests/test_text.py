from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidecue.functions import labels, text
from tidecue.sources.profiles import Character, Profile, ProfileError, list_profiles, parse_profile

SHOW = Profile("Show", (Character("Alice", ("Al", "Alice Moore"), "F"), Character("Bob", ("Bobby",), "M"), Character("Extra", (), "M", False)))


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_words_and_trigrams_of_short_and_null_texts(spark):
    got = column(spark, ["It's A one-TWO day", "a b", None, ""], text.norm_words("x"))
    assert got == [["it's", "one", "two", "day"], [], [], []]
    grams = column(spark, [["aa", "bb"], ["aa", "bb", "cc"], ["aa"] * 5, []], text.trigrams("x"), "array<string>")
    assert grams == [[], ["aa bb cc"], ["aa aa aa"], []]


def test_jaccard_of_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.jaccard("a", "b")).collect()] == [pytest.approx(1 / 3), 0.0, 0.0]


def test_subtitle_times(spark):
    assert column(spark, [0.0, -3.0, 3661.5, 59.9996, 360000.0], text.srt_time("x"), "double") == ["00:00:00,000", "00:00:00,000", "01:01:01,500", "00:01:00,000", "100:00:00,000"]


def test_emotions(spark):
    assert column(spark, ["[happy]", " (sad) ", "", None, "x" * 31, "[]"], text.clean_emotion("x")) == ["[happy]", "[sad]", "", "", "", ""]


def test_script_text_and_markup(spark):
    assert column(spark, ["a [b] c  (d) e", "&amp; it is"], text.clean_script_text("x", entities=True)) == ["a c e", "& it is"]
    assert column(spark, ["<p>Hi<b>there</b></p>"], text.clean_markup("x")) == ["Hi there"]


def test_stable_pick_is_sha1_modulo(spark):
    names = ["Ann", "Bob", "", "Zoë"]
    assert column(spark, names, text.stable_pick("x", 7)) == [int(hashlib.sha1(n.encode()).hexdigest(), 16) % 7 for n in names]


def test_fit_key_and_fingerprint(spark):
    assert column(spark, ["id"], text.fit_key("x", F.lit(1.25))) == [hashlib.sha1(b"id|1.2500").hexdigest()[:20]]
    assert text.fingerprint({"b": 1, "a": [2]}) == text.fingerprint({"a": [2], "b": 1})


def wrapped_by_a_loop(text, width):
    rest, lines = (text or "").strip(), []
    if len(rest) <= width:
        return [rest]
    while len(rest) >= width:
        marks = [k for k in range(width - 5, width) if rest[k - 1] in "，。！？、；：,.!?;… "]
        at = marks[-1] if marks else width
        lines.append(rest[:at].strip())
        rest = rest[at:]
    return [x for x in [*lines, rest.strip()] if x]


def test_wrapping_keeps_every_character_and_breaks_after_marks(spark):
    rng = random.Random(5)
    texts = ["短", "一二三四五六七八九十一二三四五，六七八九十", "abc" * 20, "x，" * 30, "", None, " " * 40, "一" * 18, "一" * 19, "😀" * 40, "𠀀，" * 30, "a" * 5000]
    texts += ["".join(rng.choice("一二ab, ，。😀\n") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    assert column(spark, texts, text.wrap_cjk("x")) == [wrapped_by_a_loop(s, 18) for s in texts]
    assert column(spark, ["abcdefghij, klm"], text.wrap_cjk("x", 8)) == [wrapped_by_a_loop("abcdefghij, klm", 8)]


def test_screens_of_two_lines(spark):
    assert column(spark, [["a", "b", "c"], [], ["a"]], text.chunk_by_two("x"), "array<string>") == [["a\nb", "c"], [""], ["a"]]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Alice", "Alice"), ("BOB:", "BOB"), ("Mrs. Smith (off)", "Mrs. Smith"), ("The", None), ("Scene 2", None), ("A", None), ("One Two Three Four Five", None), ("Agent 7", None), ("", None), ("x" * 41, None), ("123", None)],
)
def test_valid_speakers(spark, raw, want):
    assert column(spark, [raw], labels.valid_speaker("x")) == [want]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("ALICE", "Alice"), ("bobby", "Bob"), ("Alice Moore", "Alice"), ("Alice (laughing)", "Alice"), ("Bob:", "Bob"), ("Alice's Mother", "GUEST"), ("Young Bob", "GUEST"), ("Fake Alice", "GUEST"),
        ("Alice and Bob", "GROUP"), ("Alice, Carl", "Alice"), ("Everyone", "GROUP"), ("Both and all", "GROUP"), ("Carl & Dora", "GUEST"), ("Alice Q. Smith", "Alice"), ("Extra", "GUEST"), ("", "GUEST"), (None, "GUEST"),
    ],
)
def test_canonical_speakers(spark, raw, want):
    assert column(spark, [raw], labels.canonical_speaker("x", SHOW)) == [want]


def test_names_genders_and_voice_hints(spark):
    assert column(spark, ["o'brien mary-ann", "x", "(aside) carl:"], labels.display_name("x")) == ["O'Brien Mary-Ann", None, "Carl"]
    assert column(spark, ["Alice", "Bob", "Skip", "OtherMale"], labels.role_gender("x", SHOW)) == ["FEMALE", "MALE", "", "MALE"]
    assert column(spark, ["Maria", "Danielle", "Tom"], labels.guest_gender("x")) == ["FEMALE", "FEMALE", "MALE"]
    assert column(spark, ["温柔女声", "male voice", "female narrator", None, "robot"], labels.voice_gender("x")) == ["FEMALE", "MALE", "FEMALE", "", ""]
    assert column(spark, ["ASMR soft", "News"], labels.is_bad_voice("x")) == [True, False]
    assert column(spark, ["新闻", "news", None], labels.has_cjk("x")) == [True, False, False]
    assert column(spark, [None, 300.0, 301.0], labels.pitch_allowed("x"), "double") == [True, True, False]


GOOD = {"name": "S", "characters": [{"name": "Ann"}]}


@pytest.mark.parametrize(
    "bad",
    [
        [], {"characters": [{"name": "A"}]}, GOOD | {"target_language": "fr"}, {"name": "S", "characters": [{"name": "A"}, {"name": "a"}]}, {"name": "S", "characters": [{"name": "Skip"}]},
        {"name": "S", "characters": [{"name": "A", "gender": "x"}]}, {"name": "S", "characters": [{"name": "A", "main": False}]}, GOOD | {"transcripts": {"format": "pdf"}}, GOOD | {"theme": {"skip_intro_seconds": -1}}, GOOD | {"theme": {"skip_intro_seconds": "x"}},
    ],
)
def test_bad_profiles(bad):
    with pytest.raises(ProfileError):
        parse_profile(bad)


def test_profiles_of_folders(tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
    (tmp_path / "a/x.toml").write_text('name = "Old"\n[[characters]]\nname = "Ann"\n')
    (tmp_path / "b/x.toml").write_text('name = "New"\n[[characters]]\nname = "Ann"\n')
    (tmp_path / "b/TEMPLATE.toml").write_text('name = "T"\n')
    (tmp_path / "b/broken.toml").write_text("name = ")
    assert list_profiles(tmp_path / "a", tmp_path / "b", tmp_path / "none") == [("x", "New")]
    assert parse_profile(GOOD).labels == ["Ann", "OtherMale", "OtherFemale", "Skip"]


def test_hints_are_looked_for_by_one_pattern(spark):
    hints = {h for words in (labels.FEMALE_HINTS, labels.MALE_HINTS, labels.DENIED) for h in words}
    texts = [None, "", "plain", "18 +", "118+x", "SHE is a Woman\nand more", *hints, *(f"x{h.upper()}y" for h in hints), *(h[:-1] for h in hints)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    x = rows.select("t", labels.is_bad_voice("t"), labels.voice_gender("t"))
    has = lambda t, words: any(w in (t or "").lower() for w in words)
    want = [(t, has(t, labels.DENIED), "FEMALE" if has(t, labels.FEMALE_HINTS) else "MALE" if has(t, labels.MALE_HINTS) else "") for t in texts]
    assert [tuple(r) for r in x.collect()] == want
    assert "exists(" not in x._jdf.queryExecution().toString().lower()
