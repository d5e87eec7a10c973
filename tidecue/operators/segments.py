"""Recognised speech segments: credibility, repeats, monotone times, dash splits, utterances.

Rows are (episode_id, line_idx, start, end, en, words array<struct<s,e>>) and whatever else they carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col, round_to, strip

#: A sentence's end, and a dash that starts another voice after one.
SENTENCE_END = r"[.?!…\"’]\s*$"
DASH = r"(?<=[.?!…\"])\s+[-–—]\s+"
ORDER = ("episode_id", "line_idx")


def in_order(key: str = "episode_id", order: str = "line_idx") -> W:
    return W.partitionBy(key).orderBy(order)


def credible(segments: DataFrame) -> DataFrame:
    """Without empty lines and likely hallucinations (columns no_speech_prob, compression_ratio, avg_logprob)."""
    noise = (F.col("no_speech_prob") > 0.6) | ((F.col("compression_ratio") > 2.4) & (F.col("avg_logprob") < -0.5))
    return segments.where((strip(F.coalesce("en", F.lit(""))) != "") & ~F.coalesce(noise, F.lit(False)))


def drop_repeats(rows: DataFrame, text: str = "en", key: str = "episode_id", order: str = "line_idx", most: int = 2) -> DataFrame:
    """The third and later equal text in a row goes."""
    w = in_order(key, order)
    new = F.coalesce((F.col(text) != F.lag(text).over(w)).cast("int"), F.lit(0))
    runs = rows.withColumn("__run", new).withColumn("__run", F.sum("__run").over(w))
    return runs.withColumn("__nth", F.row_number().over(W.partitionBy(key, "__run").orderBy(order))).where(F.col("__nth") <= most).drop("__run", "__nth")


def valid_words(words: Column | str) -> Column:
    """Word times with positive length, to the millisecond."""
    kept = F.filter(F.coalesce(col(words), F.array().cast("array<struct<s:double,e:double>>")), lambda w: w["e"] > w["s"])
    return F.transform(kept, lambda w: F.struct(round_to(w["s"], 3).alias("s"), round_to(w["e"], 3).alias("e")))


def monotone_times(segments: DataFrame) -> DataFrame:
    """A line that starts before the one above ends starts at its end, and then lasts 0.3 s at least. The end carried
    is the corrected one, so this is a fold along the episode. It starts anew at lines that begin after all that lines
    before could reach (each moves its end by 0.3 s at most beyond the one before), so it runs along short stretches."""
    w = in_order()
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    n = F.row_number().over(w)
    x = segments.withColumn("__own", F.col("end") - 0.3 * n).withColumn("__n", n)
    reach = F.max("__own").over(earlier) + 0.3 * F.col("__n")
    x = x.withColumn("__stretch", F.coalesce((F.col("start") >= reach + 1e-6).cast("int"), F.lit(0)))
    x = x.withColumn("__stretch", F.sum("__stretch").over(w))
    rows = x.groupBy("episode_id", "__stretch").agg(F.array_sort(F.collect_list(F.struct("line_idx", "start", "end"))).alias("r"))
    seen = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<struct<line_idx:int,start:double,end:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        late = x["start"] < acc["last"]
        start = F.when(late, acc["last"]).otherwise(x["start"])
        end = F.when(late, F.greatest(x["end"], start + 0.3)).otherwise(x["end"])
        one = F.struct(x["line_idx"].cast("int").alias("line_idx"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("last"), F.concat(acc["out"], F.array(one)).alias("out"))

    fixed = rows.select("episode_id", F.inline(F.aggregate("r", seen, step, lambda a: a["out"])))
    return segments.drop("start", "end").join(fixed, list(ORDER))


def split_merged(segments: DataFrame) -> DataFrame:
    """Two voices in one line ("- A. - B") become lines of their own, with a share of the time by characters and of the
    words likewise; the last takes the words that are left. ``part`` numbers them."""
    text = F.regexp_replace(strip("en"), r"^[-–—]\s*", "")
    parts = F.filter(F.transform(F.split(text, DASH), strip), lambda p: p != "")
    x = segments.withColumns({"__text": text, "__parts": parts, "words": F.coalesce("words", F.array().cast("array<struct<s:double,e:double>>"))})
    x = x.withColumn("__parts", F.when(F.size("__parts") > 1, F.col("__parts")).otherwise(F.array("__text")))
    chars = F.transform("__parts", F.length)
    x = x.withColumns({"__n": chars, "__all": F.greatest(F.aggregate(chars, F.lit(0), lambda a, c: a + c), F.lit(1))})
    x = x.select("*", F.posexplode("__parts").alias("part", "__p"))
    before = lambda f: F.aggregate(F.slice("__n", 1, F.col("part")), F.lit(0.0), lambda a, c: a + f(c))
    share = lambda c: F.bround(F.size("words") * c / F.col("__all"))
    last = F.col("part") == F.size("__parts") - 1
    at = before(share).cast("int")
    take = F.when(last, F.size("words")).otherwise(share(F.length("__p")).cast("int"))
    x = x.withColumn("__w", F.slice("words", at + 1, F.greatest(take, F.lit(0))))
    span, all_ = F.col("end") - F.col("start"), F.col("__all")
    t0 = round_to(F.col("start") + span * before(lambda c: c.cast("double")) / all_, 3)
    t1 = round_to(F.col("start") + span * (before(lambda c: c.cast("double")) + F.length("__p")) / all_, 3)
    several, has = F.size("__parts") > 1, F.size("__w") > 0
    s = F.when(~several, F.col("start")).when(has, F.get("__w", F.lit(0))["s"]).otherwise(t0)
    e = F.when(~several, F.col("end")).when(has, F.greatest(F.element_at("__w", -1)["e"], s + 0.3)).otherwise(t1)
    x = x.withColumns({"__s": s, "__e": e})
    return x.withColumns({"start": F.col("__s"), "end": F.col("__e"), "en": F.col("__p"), "words": F.when(several, F.col("__w")).otherwise(F.col("words"))}).drop(*[c for c in x.columns if c.startswith("__")])


def merge_utterances(segments: DataFrame, most_gap: float = 0.25, most_length: float = 8.0) -> DataFrame:
    """Fragments that follow at once and without a sentence's end between them are one line, of up to ``most_length``
    seconds. Gap and punctuation are local; only the group's start has to be carried, so the fold gives numbers alone, and
    runs along stretches without a gap or a sentence's end."""
    w = in_order()
    joins = (F.col("start") - F.lag("end").over(w) <= most_gap) & ~F.lag("en").over(w).rlike(SENTENCE_END)
    x = segments.withColumn("__near", F.coalesce(joins, F.lit(False)))
    x = x.withColumn("__stretch", F.sum((~F.col("__near")).cast("int")).over(w))
    rows = x.groupBy("episode_id", "__stretch").agg(F.array_sort(F.collect_list(F.struct("line_idx", "start", "end", "__near"))).alias("r"))
    empty = F.struct(F.lit(-1).alias("g"), F.lit(0.0).cast("double").alias("from"), F.array().cast("array<struct<line_idx:int,group:int>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        on = r["__near"] & (r["end"] - acc["from"] <= most_length) & (acc["g"] >= 0)
        g = F.when(on, acc["g"]).otherwise(acc["g"] + 1)
        one = F.struct(r["line_idx"].cast("int").alias("line_idx"), g.alias("group"))
        return F.struct(g.alias("g"), F.when(on, acc["from"]).otherwise(r["start"]).alias("from"), F.concat(acc["out"], F.array(one)).alias("out"))

    numbered = rows.select("episode_id", "__stretch", F.inline(F.aggregate("r", empty, step, lambda a: a["out"])))
    numbered = numbered.withColumn("group", F.dense_rank().over(W.partitionBy("episode_id").orderBy("__stretch", "group")) - 1).drop("__stretch")
    parts = F.array_sort(F.collect_list(F.struct("line_idx", strip("en").alias("en"), F.coalesce("words", F.array().cast("array<struct<s:double,e:double>>")).alias("words"))))
    merged = x.join(numbered, list(ORDER)).groupBy("episode_id", "group").agg(F.min_by("start", "line_idx").alias("start"), F.max_by("end", "line_idx").alias("end"), parts.alias("p"))
    return merged.select("episode_id", F.col("group").alias("line_idx"), "start", "end", F.array_join("p.en", " ").alias("en"), F.flatten("p.words").alias("words"))


def clean_segments(raw: DataFrame) -> DataFrame:
    """What the recogniser returns, made ready: credible, not repeated, split, monotone, merged."""
    x = split_merged(drop_repeats(credible(raw.withColumn("words", valid_words("words")))))
    x = x.withColumn("line_idx", (F.row_number().over(W.partitionBy("episode_id").orderBy("line_idx", "part")) - 1)).drop("part")
    return merge_utterances(monotone_times(x))
