"""From recognised speech to a subtitle table: the whole chain as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, attribute, identify, subtitles, timeline, vad
from ..operators.segments import clean_segments
from ..sources.profiles import Profile
from .stages import build_once, cut, script_once


def script_of(raw: DataFrame, transcripts: DataFrame, voices: DataFrame, profile: Profile) -> DataFrame:
    """Dub lines (episode_id, line_idx, start, end, en, words, sidx, speaker, zh, emo, fallback) of recognised segments.
    ``transcripts`` are (episode_id, sidx, speaker, text) of all known episodes; ``voices`` (episode_id, line_idx, cluster,
    gender) may be empty. A recording whose match is not accepted has no script lines."""
    heard = cut(clean_segments(raw))
    who = identify.identify(heard.withColumnRenamed("episode_id", "heard_id"), transcripts).where("accepted")
    script = transcripts.join(who.select("heard_id", F.col("best_id").alias("episode_id")), "episode_id").drop("episode_id").withColumnRenamed("heard_id", "episode_id")
    script = cut(script)
    lines, spans = align.align(heard, script)
    lines, spans = cut(lines), cut(spans)
    lines = lines.join(voices, ["episode_id", "line_idx"], "left").withColumn("gender", F.coalesce("gender", F.lit("")))
    cast = cut(attribute.cast_speakers(lines, profile))
    merged = timeline.merge_by_script_line(cast).withColumnRenamed("label", "speaker")
    dub = merged.drop("fragments").withColumns({"zh": F.lit(""), "emo": F.lit(""), "fallback": F.lit(False)})
    return subtitles.insert_missing(dub, script, spans, profile)


def stored_script(spark: SparkSession, root: str, media: str, raw: DataFrame, transcripts: DataFrame, voices: DataFrame, profile: Profile) -> tuple[DataFrame, bool]:
    """``script_of`` once for a recording (``media`` identifies its content) and a profile, and whether it was edited since."""
    return script_once(spark, root, script_parts(media, profile), lambda: script_of(raw, transcripts, voices, profile))


def stored_regions(spark: SparkSession, root: str, media: str, detect: Callable[[], DataFrame], settings: object = None) -> DataFrame:
    """(episode_id, s, e): the speech that ``detect`` finds in a recording, once for it and the detector's settings."""
    return build_once(spark, root, {"stage": "speech", "media": media, "settings": settings}, detect)


def stored_voices(spark: SparkSession, root: str, media: str, raw: DataFrame, listen: Callable[[DataFrame], DataFrame], model: str) -> DataFrame:
    """(episode_id, line_idx, cluster, gender): the voices that ``listen`` tells apart in a recording's segments, once for it, its
    cleaning rules and the model's name."""
    return build_once(spark, root, {"stage": "voices", "media": media, "model": model}, lambda: listen(clean_segments(raw)))


def script_parts(media: str, profile: Profile) -> dict[str, object]:
    return {"stage": "script", "media": media, "profile": profile}


def subtitles_of(script: DataFrame, durations: DataFrame, regions: DataFrame, totals: DataFrame) -> DataFrame:
    """(episode_id, seq, start, end, zh): the voiced lines where they are placed, then what was not voiced.
    ``durations`` are (episode_id, line_idx, dur) of the clips, ``regions`` the speech, ``totals`` (episode_id, total)."""
    quiet = cut(vad.silences(regions, totals))
    voiced = script.where("not fallback")
    windows = timeline.line_windows(voiced, quiet, totals, regions)
    todo = windows.join(durations, ["episode_id", "line_idx"]).join(totals, "episode_id")
    plan = cut(timeline.plan_timeline(todo)).join(durations, ["episode_id", "line_idx"]).join(voiced.select("episode_id", "line_idx", "sidx", "zh"), ["episode_id", "line_idx"])
    placed = plan.select("episode_id", "line_idx", "sidx", F.col("place").alias("start"), (F.col("place") + F.col("dur") / F.col("tempo")).alias("end"), "zh")
    free = subtitles.place_fallbacks(script, subtitles.placed_by_sidx(placed), quiet, totals)
    return subtitles.subtitle_table(placed, free, subtitles.retained(script, placed))
