from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidecue.operators.segments import valid_words
from tidecue.plans import dub
from tidecue.plans.stages import build_once, identity
from tidecue.sources import pages, transcripts
from tidecue.sources.profiles import Character, Profile, Transcripts
from tidecue.streaming.drop_folder import watch


def lines(df):
    return [(r["sidx"], r["speaker"], r["text"]) for r in df.orderBy("episode_id", "sidx").collect()]


def raw(spark, text):
    return spark.createDataFrame([("e", text)], "episode_id string, content string")


def test_name_colon(spark):
    text = "prologue\nANN: Hello [waves] there,\n  my friend.\nBOB: x\nstill Ann\n\nThe: not a name\nMrs. Smith: Good &amp; fine.\r\nEND"
    assert lines(transcripts.parse_name_colon(raw(spark, text))) == [(0, "ANN", "Hello there, my friend. still Ann The: not a name"), (1, "Mrs. Smith", "Good & fine. END")]
    assert lines(transcripts.parse_name_colon(raw(spark, None))) == []


def test_srt(spark):
    text = "1\r\n00:00:01,000 --> 00:00:02,000\r\nANN: Hello\r\nthere.\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\nand again\r\n\r\n3\r\n00:00:04,000 --> 00:00:05,000\r\n- BOB: Yes.\r\n"
    assert lines(transcripts.parse_srt_with_speakers(raw(spark, text))) == [(0, "ANN", "Hello there. and again"), (1, "BOB", "Yes.")]


BOLD = "<script>var x='<b>No:</b>'</script><p><b>Ann:</b> It is <b>really</b> good &amp; new.</p><p><strong>Bob</strong>: Yes (nods).</p>[Scene: a room] <b>The:</b> drop"
PLAIN = "<p>ANN: Hello there</p><p>more of it</p><p>[Scene]</p><p>lost</p><p>BOB O'NEIL: Hi</p>"


def test_pages(spark):
    table = lambda text: spark.createDataFrame([("e", text)], "page_id string, html string")
    said = lambda x: [(r["speaker"], r["text"]) for r in x.orderBy("n").collect()]
    bold, plain = [("Ann", "It is really good & new."), ("Bob", "Yes .")], [("ANN", "Hello there more of it"), ("BOB O'NEIL", "Hi")]
    assert said(pages.bold_dialogue(table(BOLD))) == bold and said(pages.plain_dialogue(table(PLAIN))) == plain
    assert [(r["speaker"], r["text"]) for r in pages.page_dialogue(table(PLAIN)).orderBy("sidx").collect()] == plain
    assert pages.page_dialogue(table(None)).count() == 0 and pages.page_dialogue(table("")).count() == 0
    assert lines(transcripts.parse_pages(raw(spark, BOLD))) == [(0, "Ann", "It is really good & new."), (1, "Bob", "Yes .")]
    # nesting, closing tags too many, a label with its colon inside, comments, an endless script, entities that hold marks
    odd = "</b></strong><b>Ann: </b>one<!-- <b>No:</b> --> <b>t<strong>w</strong>o</b> &lt;three&gt;<br>four</b><b>Bob</b> : five &#65;<B>Too: many:</B> six<b></b><b>Cid</b>x<script><b>Dee:</b> gone"
    assert said(pages.bold_dialogue(table(odd))) == [("Ann", "one two <three> four"), ("Bob", "five AToo: many: sixCidx")]
    lost = "<p>ANN:</p><p>BOB: (nods)</p>SCENE: no name<br>MARY-LOU: a\x0bb&amp;amp;c<br>(aside)<br>more<br>X: short name"
    assert said(pages.plain_dialogue(table(lost))) == [("MARY-LOU", "a b&c")]


def test_local_folder_and_build_once(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / "0101.txt").write_text("".join(f"ANN: line number {i}\n" for i in range(6)))
    (src / "0102.txt").write_text("ANN: too short\n")
    (src / ".hidden").write_text("ANN: no\n" * 9)
    t = Transcripts(local_folder=str(src))
    first = transcripts.ensure_transcripts(spark, t, str(out))
    assert {r["episode_id"] for r in first.collect()} == {"0101"} and first.count() == 6
    (src / "0103.txt").write_text("BOB: line of text\n" * 7)
    assert transcripts.ensure_transcripts(spark, t, str(out)).count() == 6
    assert transcripts.ensure_transcripts(spark, Transcripts(local_folder=str(src), revision="2"), str(out)).count() == 13


def test_build_once_runs_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert [build_once(spark, str(tmp_path / "s"), {"a": 1}, build).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    assert identity({"a": 1}) != identity({"a": 2})


def test_remote_pages_and_codes(spark):
    t = Transcripts(url_base=("http://x/",), url_suffix=".html", episodes_per_season=(2, 1), covered_by_multi=("0102",), multi_part_pages=("0102-0103",))
    assert [r[0] for r in transcripts.episode_codes(spark, t).orderBy("pos").select("episode_id").collect()] == ["0101", "0201", "0102-0103"]
    urls = transcripts.remote_urls(spark, t)
    assert {r["url"] for r in urls.collect()} == {"http://x/0101.html", "http://x/0201.html", "http://x/0102-0103.html"}

    def fetch(url):
        if "0201" in url:
            raise OSError("gone")
        return "".join(f"<p>ANN: text {i}</p>" for i in range(5 if "0101" in url else 2))

    assert {r["episode_id"] for r in transcripts.load_remote(urls, fetch, "html").collect()} == {"0101"}
    named = transcripts.remote_urls(spark, Transcripts(url_list=("http://y/a/0305.htm",), url_base=("z",)))
    assert [tuple(r) for r in named.collect()] == [("0305", "http://y/a/0305.htm")]


def test_word_times(spark):
    df = spark.createDataFrame([([(0.0, 0.5), (1.0, 1.0), (1.23456, 2.0)],), (None,)], "words array<struct<s:double,e:double>>")
    assert [[tuple(w) for w in r[0]] for r in df.select(valid_words("words")).collect()] == [[(0.0, 0.5), (1.235, 2.0)], []]


def test_watched_folder_runs_new_files_once(spark, tmp_path):
    src = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    src.write.parquet(str(tmp_path / "in"))
    go = lambda: watch(spark, str(tmp_path / "in"), src.schema, lambda d: d.withColumn("m", F.col("n") * 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    go()
    assert sorted(r["m"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]


def test_from_speech_to_subtitles(spark):
    show = Profile("Show", (Character("Ann", (), "F"), Character("Bob", (), "M")))
    said = ["good morning to you my dear friend", "what a lovely day it is today", "shall we walk along the river now", "yes let us go before the rain comes", "bring your old umbrella with you please"]
    t = spark.createDataFrame([("0101", i, "Ann" if i % 2 == 0 else "Bob", s.capitalize() + ".") for i, s in enumerate(said)] + [("0102", i, "Bob", f"unrelated filler words number {i}") for i in range(5)], "episode_id string, sidx int, speaker string, text string")
    heard = [(i, s) for i, s in enumerate(said) if i != 2]
    raw = spark.createDataFrame([("v", i, 4.0 * i, 4.0 * i + 2.0, s + ".", [(4.0 * i + 0.2 * k, 4.0 * i + 0.2 * k + 0.15) for k in range(len(s.split()))], 0.1, 1.0, 0.0) for i, s in heard], "episode_id string, line_idx int, start double, end double, en string, words array<struct<s:double,e:double>>, no_speech_prob double, compression_ratio double, avg_logprob double")
    voices = spark.createDataFrame([], "episode_id string, line_idx int, cluster int, gender string")
    script = dub.script_of(raw, t, voices, show).cache()
    got = [(r["sidx"], r["speaker"], r["fallback"]) for r in script.orderBy("line_idx").collect()]
    assert got == [(0, "Ann", False), (1, "Bob", False), (2, "Ann", True), (3, "Bob", False), (4, "Ann", False)]
    done = script.withColumn("zh", F.when(~F.col("fallback"), F.concat(F.lit("译"), F.col("sidx").cast("string"))).otherwise("补"))
    durations = script.where("not fallback").select("episode_id", "line_idx", F.lit(1.5).alias("dur"))
    regions = script.where("not fallback").select("episode_id", F.col("start").alias("s"), F.col("end").alias("e"))
    totals = spark.createDataFrame([("v", 20.0)], "episode_id string, total double")
    subs = [(r["zh"], round(r["start"], 2)) for r in dub.subtitles_of(done, durations, regions, totals).orderBy("seq").collect()]
    assert [z for z, _ in subs] == ["译0", "译1", "补", "译3", "译4"] and [s for _, s in subs] == sorted(s for _, s in subs)


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "identify_document" in e.queries()


def ordered_rows(table):
    """All rows with their columns by name, in an order that the last digits of a fraction do not change."""
    table = table[sorted(table.columns)].astype(object)
    rows = [[None if isinstance(v, float) and v != v else v for v in r] for r in table.where(table.notna(), None).values.tolist()]
    return sorted(rows, key=lambda r: [f"{v:.6g}" if isinstance(v, float) else repr(v) for v in r])


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="the driver's tables are not here")
def test_registered_queries_agree_with_sql(spark):
    import duckdb

    from tidecue.plans import catalog, dialogue, episodes, sequences

    queries = catalog.QUERIES | dialogue.QUERIES | episodes.QUERIES | sequences.QUERIES
    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for f in sorted(Path(sf).glob("*.parquet")):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, sql in (catalog.ORACLES | dialogue.ORACLES | episodes.ORACLES | sequences.ORACLES).items():
        got, want = queries[name](spark, sf).toPandas(), db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        got, want = ordered_rows(got), ordered_rows(want)
        assert len(got) == len(want), name
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b), name


def test_the_rest_stands_without_the_corpus_operators():
    """Nothing outside the subpackage imports it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "tidecue"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f
