"""Which transcript a recording matches: containment of its word trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_words, trigrams

#: Least score that is accepted, least ratio to the runner-up that is clear.
ACCEPT, CLEAR = 0.12, 1.6


def line_trigrams(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, trigram) of each line, distinct within it; trigrams don't cross lines. The words are materialised before they are
    windowed."""
    words = lines.select(F.col(key), norm_words(text).alias("w"))
    return words.select(key, F.explode(trigrams("w")).alias("trigram"))


def identify(heard: DataFrame, transcripts: DataFrame, heard_key: str = "heard_id", key: str = "episode_id", heard_text: str = "en", text: str = "text") -> DataFrame:
    """For each recording with a trigram: best transcript (ties: the smaller id), its score, the runner-up's, and
    whether it is accepted and clear. A recording that shares nothing gets the smallest id with score 0.

    The two sides are joined on the trigram, and only what both have is made distinct: the transcripts' other trigrams, nearly
    all of them, are never shuffled where what is heard is small enough for Spark to send to all tasks."""
    h = line_trigrams(heard, heard_key, heard_text).distinct()
    n = h.groupBy(heard_key).agg(F.count(F.lit(1)).alias("n"))
    shared = line_trigrams(transcripts.where(F.col(text).isNotNull()), key, text).join(h, "trigram").dropDuplicates([heard_key, key, "trigram"])
    score = shared.groupBy(heard_key, key).agg(F.count(F.lit(1)).alias("shared")).join(n, heard_key).withColumn("score", F.col("shared") / F.col("n"))
    w = W.partitionBy(heard_key).orderBy(F.desc("score"), key)
    top = score.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rank = 1")
    best = n.join(top.select(heard_key, key, "score", "next"), heard_key, "left")
    zero, first = F.lit(0.0), transcripts.agg(F.min(key)).scalar()
    out = best.select(heard_key, F.coalesce(key, first).alias("best_id"), F.coalesce("score", zero).alias("score"), F.coalesce("next", zero).alias("runner_up"))
    ratio = F.col("score") / F.when(F.col("runner_up") == 0, 0.001).otherwise(F.col("runner_up"))
    return out.withColumns({"accepted": F.col("score") >= ACCEPT, "clear": ratio >= CLEAR})


def match_report(lines: DataFrame) -> DataFrame:
    """Of each episode's (exact_sidx, sidx): lines, exact and inferred matches, their share, and a warning below 0.55."""
    exact, matched = F.count("exact_sidx"), F.count("sidx")
    out = lines.groupBy("episode_id").agg(F.count(F.lit(1)).alias("lines"), exact.alias("exact"), (matched - exact).alias("inferred"), (matched / F.count(F.lit(1))).alias("matched"))
    return out.withColumn("doubtful", F.col("matched") < 0.55)
