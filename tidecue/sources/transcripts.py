"""Transcript sources: local text, subtitles and pages become (episode_id, sidx, speaker, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import valid_speaker
from ..functions.text import clean_script_text, strip
from ..plans.stages import build_once
from .pages import page_dialogue
from .profiles import FORMATS, Transcripts

#: A transcript with fewer lines was most likely read in the wrong format.
LEAST_LINES = 5
PARSER_VERSION = 1


def _utterances(lines: DataFrame) -> DataFrame:
    """From (episode_id, pos, starts, speaker, body): rows that start an utterance number it, the others join the one
    before; what comes before the first is dropped."""
    order = W.partitionBy("episode_id").orderBy("pos")
    lines = lines.withColumn("sidx", F.sum(F.col("starts").cast("int")).over(order) - 1).where("sidx >= 0")
    said = F.array_sort(F.collect_list(F.struct("pos", "body")))
    joined = lines.groupBy("episode_id", "sidx").agg(F.max("speaker").alias("speaker"), said.alias("said"))
    return joined.select("episode_id", F.col("sidx").cast("int").alias("sidx"), "speaker", F.array_join("said.body", " ").alias("text"))


def parse_name_colon(raw: DataFrame) -> DataFrame:
    """``NAME: text`` lines of (episode_id, content). Lines without a valid name go on with the last utterance given
    out; a valid name with less than two characters after it is dropped."""
    pattern = r"^([^:]{1,45}?)(?U:\s*):(?U:\s*)(.*)$"
    lines = raw.select("episode_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\R")).alias("pos", "line"))
    lines = lines.withColumn("line", strip("line")).where("line <> ''")
    named = F.when(F.col("line").rlike(pattern), valid_speaker(F.regexp_extract("line", pattern, 1)))
    lines = lines.withColumn("speaker", named)
    said = F.when(F.col("speaker").isNotNull(), F.regexp_extract("line", pattern, 2)).otherwise(F.col("line"))
    lines = lines.withColumn("body", clean_script_text(said, entities=True))
    lines = lines.withColumn("starts", F.col("speaker").isNotNull() & (F.length("body") >= 2))
    return _utterances(lines.where("starts or (speaker is null and body <> '')"))


def parse_srt_with_speakers(raw: DataFrame) -> DataFrame:
    """Subtitles whose cues may start with a name: number and time lines go, a cue without a name joins the last."""
    pattern = r"^[-\s]*([^:]{1,45}?)\s*:\s*(.*)$"
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n")
    cues = raw.select("episode_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "block"))
    spoken = F.filter(F.transform(F.split("block", r"\R"), strip), lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~F.contains(x, F.lit("-->")))
    cues = cues.select("episode_id", "pos", F.array_join(spoken, " ").alias("cue")).where("cue <> ''")
    cues = cues.withColumn("named", F.col("cue").rlike(pattern))
    cues = cues.withColumn("speaker", F.when(F.col("named"), valid_speaker(F.regexp_extract("cue", pattern, 1))))
    said = F.when(F.col("named"), F.regexp_extract("cue", pattern, 2)).otherwise(F.col("cue"))
    cues = cues.withColumn("body", clean_script_text(said, entities=True)).where(F.length("body") >= 2)
    return _utterances(cues.withColumn("starts", F.col("speaker").isNotNull()))


def parse_pages(raw: DataFrame) -> DataFrame:
    """Web pages."""
    return page_dialogue(raw, "episode_id", "content")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"name_colon": parse_name_colon, "srt_with_speakers": parse_srt_with_speakers, "html": parse_pages}
assert tuple(PARSERS) == FORMATS


def long_enough(lines: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """Without the episodes that have fewer lines."""
    return lines.join(lines.groupBy("episode_id").count().where(F.col("count") >= least).select("episode_id"), "episode_id", "left_semi")


def load_local(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Every file of a folder that isn't hidden; the file name without its ending is the episode."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    name = F.regexp_replace(F.url_decode("file"), r"\.[^.]*$", "")
    return long_enough(PARSERS[kind](files.select(name.alias("episode_id"), "content")))


def load_remote(urls: DataFrame, fetch: Callable[[str], str], kind: str) -> DataFrame:
    """Pages of (episode_id, url). ``fetch`` runs on the executors, with its own retries; what fails is left out."""

    def get(batches):
        for b in batches:
            got = []
            for url in b["url"]:
                try:
                    got.append(fetch(url))
                except Exception:  # noqa: BLE001  a missing page is no reason to lose the others
                    got.append(None)
            yield b.assign(content=got)[["episode_id", "content"]]

    pages = urls.select("episode_id", "url").mapInPandas(get, "episode_id string, content string")
    return long_enough(PARSERS[kind](pages.where("content is not null")))


def episode_codes(spark: SparkSession, t: Transcripts) -> DataFrame:
    """Expected episodes: SSEE for each season and number, without those that a multi-part page covers, then the
    multi-part pages (pos gives the order)."""
    seasons = spark.createDataFrame([(i, int(n)) for i, n in enumerate(t.episodes_per_season, 1) if int(n) > 0], "season int, n int")
    each = seasons.select("season", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    pad = lambda c: F.when(F.col(c) > 99, F.col(c).cast("string")).otherwise(F.lpad(F.col(c).cast("string"), 2, "0"))
    each = each.select((F.col("season") * 1000 + F.col("number")).alias("pos"), F.concat(pad("season"), pad("number")).alias("episode_id"))
    covered = spark.createDataFrame([(str(x),) for x in t.covered_by_multi], "episode_id string")
    parts = spark.createDataFrame([(1_000_000 + i, str(x)) for i, x in enumerate(t.multi_part_pages)], "pos int, episode_id string")
    return each.join(covered, "episode_id", "left_anti").select("pos", "episode_id").unionByName(parts)


def remote_urls(spark: SparkSession, t: Transcripts) -> DataFrame:
    """(episode_id, url): an explicit list wins, its last path parts name the episodes; else the first base and the codes."""
    if t.url_list:
        rows = spark.createDataFrame([(u,) for u in t.url_list], "url string")
        return rows.select(F.regexp_replace(F.regexp_extract("url", r"([^/]+)/*$", 1), r"\.[^.]*$", "").alias("episode_id"), "url")
    base = t.url_base[0] if t.url_base else ""
    return episode_codes(spark, t).select("episode_id", F.concat(F.lit(base), "episode_id", F.lit(t.url_suffix)).alias("url"))


def ensure_transcripts(spark: SparkSession, t: Transcripts, root: str, fetch: Callable[[str], str] | None = None) -> DataFrame:
    """The transcript table of a profile, built once: its path is the fingerprint of the source and the parser."""

    def build() -> DataFrame:
        if t.local_folder:
            return load_local(spark, t.local_folder, t.format)
        if fetch is None:
            raise ValueError("remote transcripts need a fetch function")
        return load_remote(remote_urls(spark, t), fetch, t.format)

    return build_once(spark, root, {"transcripts": t, "parser": PARSER_VERSION}, build)
