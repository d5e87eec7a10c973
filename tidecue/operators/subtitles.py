"""Lines that were not voiced, and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_SECOND, chunk_by_two, let, round_to, srt_time, strip, wrap_cjk
from ..plans.stages import cut
from ..sources.profiles import Profile
from .attribute import fallback_speaker
from .lookup import NUMBERS, SECONDS, asof, numbered
from .timeline import MIN_GAP, largest_quiet

COVERAGE, MIN_DUR, MAX_DUR = 0.35, 1.0, 3.5


def anchors(script: DataFrame, spans: DataFrame) -> DataFrame:
    """(episode_id, sidx, a0, a1): when each covered script line is spoken, by its words or else by its first dub line."""
    own = script.where("sidx is not null").groupBy("episode_id", "sidx").agg(F.min_by(F.struct("start", "end"), "line_idx").alias("t"))
    x = own.join(spans.select("episode_id", "sidx", "onset", F.col("end").alias("__e")), ["episode_id", "sidx"], "left")
    end = F.coalesce("__e", F.greatest(F.coalesce("t.end", F.col("t.start") + 0.4), F.col("t.start") + 0.3))
    return x.select("episode_id", "sidx", F.coalesce("onset", "t.start").alias("a0"), end.alias("a1"))


def missing_lines(script: DataFrame, transcript: DataFrame, spans: DataFrame, profile: Profile) -> DataFrame:
    """Subtitle-only rows for the transcript lines that no dub line covers, spread evenly between their neighbours:
    episode_id, sidx, start, end, en, speaker, zh, emo, words, fallback. None where too little of the transcript is covered."""
    anchor = anchors(script, spans)
    total = transcript.groupBy("episode_id").agg(F.count(F.lit(1)).alias("total"))
    covered = anchor.groupBy("episode_id").agg(F.count(F.lit(1)).alias("covered"), F.max("a1").alias("last_end"))
    trusted = total.join(covered, "episode_id").where(F.col("covered") / F.col("total") >= COVERAGE).select("episode_id", "last_end")
    x = transcript.join(trusted, "episode_id").join(anchor, ["episode_id", "sidx"], "left")
    w = W.partitionBy("episode_id").orderBy("sidx")
    x = x.withColumns({
        "lo": F.coalesce(F.last("a1", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)),
        "hi": F.coalesce(F.first("a0", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("last_end") + 3.0),
    }).where("a0 is null")
    x = x.withColumn("run", F.col("sidx") - F.row_number().over(w))
    run = W.partitionBy("episode_id", "run")
    x = x.withColumns({"n": F.count(F.lit(1)).over(run), "k": F.row_number().over(run.orderBy("sidx"))})
    x = x.withColumn("hi", F.when(F.col("hi") <= F.col("lo") + 1e-6, F.col("lo") + 2.0 * F.col("n")).otherwise(F.col("hi")))
    words = F.size(F.filter(F.split(strip(F.coalesce("text", F.lit(""))), r"(?U)\s+"), lambda t: t != ""))
    need = F.greatest(F.lit(2.0), 0.45 * words)
    x = x.withColumn("st", F.greatest(F.col("lo"), F.col("lo") + (F.col("hi") - F.col("lo")) / (F.col("n") + 1) * F.col("k") - need / 2))
    end = F.greatest(F.least("hi", F.col("st") + need), F.col("st") + 0.5)
    none = F.array().cast("array<struct<s:double,e:double>>")
    return x.select(
        "episode_id", "sidx", round_to("st", 3).alias("start"), round_to(end, 3).alias("end"), F.col("text").alias("en"),
        fallback_speaker("speaker", profile).alias("speaker"), F.lit("").alias("zh"), F.lit("").alias("emo"), none.alias("words"), F.lit(True).alias("fallback"),
    )


def script_order(script: DataFrame) -> DataFrame:
    """``script`` with its lines numbered anew (line_idx) by (start, sidx), those without a sidx last among equal starts; lines that are
    equal in both keep the order of the line_idx they had. Lines are numbered by stretches of time."""
    if "line_idx" not in script.columns:
        script = script.withColumn("line_idx", F.lit(None).cast("int"))
    by = ["start", F.col("sidx").asc_nulls_last(), F.col("line_idx").asc_nulls_last()]
    x = numbered(script, ["episode_id"], by, F.col("start"), "__n", cell=SECONDS)
    return x.withColumn("line_idx", F.col("__n").cast("int")).drop("__n", "__n_of")


def insert_missing(script: DataFrame, transcript: DataFrame, spans: DataFrame, profile: Profile) -> DataFrame:
    """The script with the missing lines, numbered anew by (start, sidx)."""
    added = missing_lines(script, transcript, spans, profile)
    x = script.unionByName(added, allowMissingColumns=True).withColumn("fallback", F.coalesce("fallback", F.lit(False)))
    return script_order(x)


def placed_by_sidx(placed: DataFrame) -> DataFrame:
    return placed.where("sidx is not null").groupBy("episode_id", "sidx").agg(F.min("start").alias("p0"), F.max("end").alias("p1"))


def _text() -> Column:
    return strip(F.coalesce(F.when(F.col("zh") != "", F.col("zh")), "en", F.lit("")))


def place_fallbacks(script: DataFrame, placed: DataFrame, silences: DataFrame, totals: DataFrame) -> DataFrame:
    """(episode_id, start, end, zh, line_idx) of the fallback lines: in even slots of the largest silence between the placed lines
    around them, in the order of (sidx, line_idx); where nothing is placed, at their provisional times, if they have a text.

    ``placed`` has one row (episode_id, sidx, p0, p1) for each placed script line. The lines between the same two placed ones
    share a gap; it may end before it starts, or hold no silence. Neighbours are looked up and lines numbered by cells of
    script lines, so a long gap is split like any other rows."""
    rows = script.where("fallback").select("episode_id", "line_idx", "sidx", "start", "end", _text().alias("text"))
    any_placed = placed.where("sidx is not null").select("episode_id").distinct().withColumn("some", F.lit(True))
    rows = cut(rows.join(any_placed, "episode_id", "left").withColumn("free", F.col("sidx").isNull() | F.col("some").isNull()).drop("some"))
    near = {"mark": "sidx", "cell": NUMBERS}
    x = asof(rows.where("not free"), placed, F.col("sidx"), "before", value=F.struct("sidx", "p1"), strict=True, **near)
    x = asof(x, placed, F.col("sidx"), "behind", value=F.struct("sidx", "p0"), forward=True, **near)
    x = x.select("episode_id", "line_idx", "sidx", "text", F.col("before.sidx").alias("after_sidx"), (F.col("before.p1") + MIN_GAP).alias("lo"), (F.col("behind.p0") - MIN_GAP).alias("hi"))
    x = x.join(totals.select("episode_id", "total"), "episode_id").withColumns({"after_sidx": F.coalesce("after_sidx", F.lit(-1)), "lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", "total")})
    x = cut(numbered(x, ["episode_id", "after_sidx"], ["sidx", "line_idx"], F.col("sidx"), "k"))
    g = x.groupBy("episode_id", "after_sidx").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + MIN_DUR * F.col("n")).otherwise(F.col("hi")))
    g = largest_quiet(g, silences, ["episode_id", "after_sidx"])
    x = x.drop("lo", "hi").join(g, ["episode_id", "after_sidx"])
    slot = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.0)) / F.col("n")
    want = F.when(F.col("text") != "", F.greatest(F.lit(MIN_DUR), F.least(F.lit(MAX_DUR), F.length("text") / CHARS_PER_SECOND))).otherwise(MIN_DUR)
    x = x.withColumns({"st": F.col("lo") + F.col("k") * slot, "len": F.least(want, F.greatest(slot - MIN_GAP, F.lit(MIN_DUR)))})
    even = x.select("episode_id", round_to("st", 3).alias("start"), round_to(F.greatest(F.col("st") + F.col("len"), F.col("st") + MIN_DUR), 3).alias("end"), F.col("text").alias("zh"), "line_idx")
    own = rows.where("free and text <> ''").withColumn("e", F.greatest(F.coalesce("end", F.col("start") + MIN_DUR), F.col("start") + MIN_DUR))
    return even.unionByName(own.select("episode_id", round_to("start", 3).alias("start"), round_to("e", 3).alias("end"), F.col("text").alias("zh"), "line_idx"))


def retained(script: DataFrame, placed: DataFrame) -> DataFrame:
    """Lines that could not be voiced, as subtitles: neither skipped nor fallback nor among ``placed`` (episode_id, line_idx)."""
    x = script.where("speaker <> 'Skip' and not coalesce(fallback, false)").join(placed.select("episode_id", "line_idx"), ["episode_id", "line_idx"], "left_anti")
    text = F.coalesce(F.when(F.col("zh") != "", F.col("zh")), strip(F.coalesce("en", F.lit(""))))
    end = F.greatest(F.coalesce("end", F.col("start") + 1.5), F.col("start") + 1.0)
    return x.select("episode_id", "start", end.alias("end"), text.alias("zh")).where("zh <> ''")


def subtitle_table(*parts: DataFrame) -> DataFrame:
    """Planned, fallback and retained entries in order of their start; equal starts keep the order of the parts."""
    x = None
    for i, p in enumerate(parts):
        p = p.select("episode_id", "start", "end", "zh", F.lit(i).alias("__part"))
        x = p if x is None else x.unionByName(p)
    return x.withColumn("seq", F.row_number().over(W.partitionBy("episode_id").orderBy("start", "__part", "end", "zh")) - 1).drop("__part")


def srt_cues(entries: DataFrame) -> DataFrame:
    """(episode_id, n, cue): SubRip cues of (episode_id, seq, start, end, zh); a long text is shown two lines at a time."""
    x = entries.select("episode_id", "seq", "start", F.greatest(F.col("end") - F.col("start"), F.lit(0.4)).alias("span"), let(wrap_cjk("zh"), chunk_by_two).alias("screens"))
    x = x.select("*", F.posexplode("screens").alias("part", "text"))
    each = F.col("span") / F.size("screens")
    x = x.withColumn("st", F.col("start") + F.col("part") * each).withColumn("en", F.col("st") + each)
    x = numbered(x, ["episode_id"], ["seq", "part"], F.col("seq"), "at")
    n = F.col("at") + 1
    cue = F.concat(n.cast("string"), F.lit("\n"), srt_time("st"), F.lit(" --> "), srt_time("en"), F.lit("\n"), "text", F.lit("\n"))
    return x.select("episode_id", n.alias("n"), cue.alias("cue"))


def write_srt(entries: DataFrame, path: str) -> None:
    """One SubRip text for each episode, in folders ``episode_id=...``."""
    text = srt_cues(entries).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("n", "cue"))).alias("c"))
    text.select("episode_id", F.array_join("c.cue", "\n").alias("value")).write.mode("overwrite").partitionBy("episode_id").text(path)
