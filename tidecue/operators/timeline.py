"""Lines on a timeline: windows from words and silences, islands of script lines, deadlines and placement."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, norm_words, round_to
from ..plans.stages import cut
from .lookup import NUMBERS, SECONDS, asof, running_most

#: Seconds: air between lines, pause that splits a speech, drift allowed, bridged pause. Greatest speed-up.
MIN_GAP, SPLIT_GAP, MAX_LAG, BRIDGE, MAX_SPEEDUP = 0.12, 2.0, 4.0, 1.0, 1.6
_TINY = 1e-6
_INTERVALS = "array<struct<s:double,e:double>>"


def overlap_end(lines: DataFrame, regions: DataFrame, key: str = "episode_id", slack: float = 0.4, cell: float = 60.0) -> DataFrame:
    """Adds ``reach``: ``end`` of each (key, line_idx, onset, end, next_onset) moved to where the speech that meets it ends,
    not past the next onset and never inward. The condition has the line's own end only, so a plain maximum does. The
    range join is an equi join on time cells that both sides are laid over; meeting twice doesn't change a maximum."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))).alias("__cell")
    a = lines.select(key, "line_idx", "onset", "end", cells(F.col("onset"), F.col("end") + slack))
    b = regions.where("e >= s").select(key, "s", "e", cells(F.col("s"), F.col("e")))
    far = a.join(b, [key, "__cell"]).where((F.col("e") > F.col("onset")) & (F.col("s") < F.col("end") + slack))
    x = lines.join(far.groupBy(key, "line_idx").agg(F.max("e").alias("__far")), [key, "line_idx"], "left")
    reach = F.greatest(F.least(F.greatest(F.coalesce("__far", "end"), "end"), "next_onset"), "end")
    return x.withColumn("reach", reach).drop("__far")


def nearest_silences(lines: DataFrame, silences: DataFrame, totals: DataFrame, key: str = "episode_id") -> DataFrame:
    """Adds ``quiet_before``, the last silence's end up to each line's onset (0 if none), and ``quiet_after``, the first
    silence's start from its end on (the total if none): two as-of joins as running values over a union."""

    def asof(time: Column, mark: str, forward: bool, name: str) -> DataFrame:
        ask = lines.select(key, "line_idx", time.alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("side"))
        x = ask.unionByName(silences.select(key, F.lit(None).cast("int").alias("line_idx"), F.col(mark).alias("t"), F.col(mark).alias("v"), F.lit(0).alias("side")))
        # silences stand before the lines of the same time
        w = W.partitionBy(key).orderBy(F.col("t").desc() if forward else F.col("t"), "side").rowsBetween(W.unboundedPreceding, 0)
        return x.withColumn(name, F.last("v", ignorenulls=True).over(w)).where("side = 1").select(key, "line_idx", name)

    before = asof(F.col("onset") + _TINY, "e", False, "quiet_before")
    after = asof(F.col("end") - _TINY, "s", True, "quiet_after")
    x = lines.join(before, [key, "line_idx"], "left").join(after, [key, "line_idx"], "left").join(totals.select(key, F.col("total").alias("__t")), key, "left")
    return x.withColumns({"quiet_before": F.coalesce("quiet_before", F.lit(0.0)), "quiet_after": F.coalesce("quiet_after", "__t")}).drop("__t")


def largest_quiet(spans: DataFrame, silences: DataFrame, keys: list[str], key: str = "episode_id", cell: float = 300.0) -> DataFrame:
    """Replaces lo, hi of (keys, lo, hi) by the longest silence within, if it has 0.4 s (ties: the earliest). Spans and
    silences meet in the time cells that both lie over; meeting twice doesn't change a maximum."""
    met = lambda df, lo, hi: df.where(F.col(hi) >= F.col(lo)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    hit = met(spans, "lo", "hi").join(met(silences.select(key, "s", "e"), "s", "e"), [key, "__cell"])
    hit = hit.withColumns({"a": F.greatest("lo", "s"), "b": F.least("hi", "e")}).where("b > a")
    best = hit.groupBy(*keys).agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("q"))
    fits = F.col("q.b") - F.col("q.a") >= 0.4
    x = spans.join(best, keys, "left")
    return x.withColumns({"lo": F.when(fits, F.col("q.a")).otherwise(F.col("lo")), "hi": F.when(fits, F.col("q.b")).otherwise(F.col("hi"))}).drop("q")


def raw_windows(lines: DataFrame) -> DataFrame:
    """Adds ``onset`` and ``word_end``: first word's start; end of the last word, or of the one before the first pause over
    two seconds; 0.3 s apart at least. Without words the line's own times."""
    w = F.filter(F.coalesce("words", F.array().cast(_INTERVALS)), lambda x: x["e"] > x["s"])
    x = lines.withColumn("__w", w)
    n = F.size("__w")
    at = F.when(n > 1, F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get("__w", i)["s"] - F.get("__w", i - 1)["e"] > SPLIT_GAP)).otherwise(F.array().cast("array<int>"))
    last = F.when(F.size(at) > 0, F.get("__w", F.get(at, F.lit(0)) - 1)["e"]).otherwise(F.get("__w", n - 1)["e"])
    onset = F.coalesce(F.get("__w", F.lit(0))["s"], "start", F.lit(0.0))
    end = F.when(n > 0, last).otherwise(F.coalesce("end", onset + 0.4))
    return x.withColumn("onset", onset).withColumn("word_end", F.greatest(end, F.col("onset") + 0.3)).drop("__w")


def quiet_stretches(silences: DataFrame, key: str = "episode_id") -> DataFrame:
    """(key, s, e, reach, upto) of distinct silences, in the order of (s, e): ``reach`` is the latest end so far, ``upto`` the end of
    the stretch of adjoining silences that each one lies in. Silences may overlap."""
    x = silences.where("s is not null and e is not null").select(key, F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"))
    x = cut(running_most(cut(x.distinct()), ["s", "e"], "e", "reach", key=key))
    # a stretch begins where all silences that start earlier are over
    x = asof(x, x, F.col("s"), "__over", key=key, mark="s", tie=("reach",), value=F.col("reach"), strict=True)
    begins = x.where("__over is null or s - 1e-6 > __over").select(key, F.col("s").alias("t")).distinct()
    x = asof(x.drop("__over"), begins, F.col("s"), "stretch", key=key, value=F.col("t"))
    return x.join(x.groupBy(key, "stretch").agg(F.max("e").alias("upto")), [key, "stretch"]).drop("stretch")


def line_windows(lines: DataFrame, silences: DataFrame, totals: DataFrame, speech: DataFrame | None = None) -> DataFrame:
    """(episode_id, line_idx, onset, word_end, quiet_before, quiet_after): each line's true window. Its end goes out to the
    end of the speech it is in, then the window is moved out of silences: an onset to the end of its stretch of adjoining
    silences, an end back to where the silence it lies in starts, or the first one after the onset.

    All that a line needs of silences and speech are lookups by place, in sorted running values; no episode's silences are
    held together. Silences and speech may overlap and repeat; a line of an episode without any keeps its words' window, and
    one of an episode without a total has no ``quiet_after`` unless a silence follows."""
    x = raw_windows(lines).select("episode_id", "line_idx", F.col("onset").cast("double").alias("onset"), F.col("word_end").cast("double").alias("word_end"))
    # the next line by number, not by time
    x = asof(x, x.select("episode_id", F.col("line_idx").alias("t"), "onset"), F.col("line_idx"), "next", value=F.col("onset"), forward=True, strict=True, cell=NUMBERS)
    x = x.join(totals.select("episode_id", "total"), "episode_id", "left").withColumn("next", F.coalesce("next", "total"))
    if speech is not None:
        regions = cut(running_most(cut(speech.where("s is not null and e is not null").select("episode_id", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"))), ["s", "e"], "e", "reach"))
        # of all speech that starts before the end, the latest end; if it lies before the line, it changes nothing
        x = asof(x, regions, F.col("word_end") + 0.4, "far", mark="s", tie=("reach",), value=F.col("reach"), strict=True)
        x = x.join(regions.select("episode_id").distinct().withColumn("some", F.lit(True)), "episode_id", "left")
        far = F.greatest(F.least(F.greatest(F.coalesce("far", "word_end"), "word_end"), F.coalesce("next", "word_end")), "word_end")
        x = x.withColumn("word_end", F.when(F.col("some"), far).otherwise(F.col("word_end"))).drop("far", "some")
    quiet = cut(quiet_stretches(silences))
    early, late = quiet.withColumn("t", F.col("s") - _TINY), quiet.withColumn("t", F.col("reach") + _TINY)
    x = asof(x, early, F.col("onset"), "at", tie=("s",), value=F.col("upto"))
    x = asof(x, late, F.col("word_end"), "over", tie=("s",), value=F.col("s"), forward=True)
    x = x.withColumns({"onset": F.greatest("onset", "at"), "word_end": F.when(F.col("over") < F.col("word_end"), F.col("over")).otherwise(F.col("word_end"))})
    x = asof(x, quiet.withColumn("t", F.col("s")), F.col("onset"), "inner", value=F.col("s"), forward=True, strict=True)
    x = x.withColumn("word_end", F.greatest(F.when(F.col("inner") < F.col("word_end"), F.col("inner")).otherwise(F.col("word_end")), F.col("onset") + 0.3))
    # the silence before the first one that ends later
    x = asof(x, quiet.withColumn("t", F.col("reach")), F.col("onset") + _TINY, "before", tie=("s", "e"), value=F.struct("s", "e"))
    x = asof(x, quiet.withColumn("t", F.col("s")), F.col("word_end") - _TINY, "after", value=F.col("s"), forward=True)
    r4 = lambda c, name: round_to(c, 4).alias(name)
    return x.select("episode_id", "line_idx", r4(F.col("onset"), "onset"), r4(F.col("word_end"), "word_end"), r4(F.coalesce("before.e", F.lit(0.0)), "quiet_before"), r4(F.coalesce("after", "total"), "quiet_after"))


def mark_islands(rows: DataFrame, key: str = "episode_id", order: str = "line_idx") -> DataFrame:
    """Adds ``island``: a row goes on with the one before if both are of one script line (sidx) and label with a pause of
    SPLIT_GAP at most; one row without sidx is bridged if the same line and label go on right after short pauses."""
    w = W.partitionBy(key).orderBy(order)
    lag, lead = (lambda c, n=1: F.lag(c, n).over(w)), (lambda c: F.lead(c).over(w))
    gap, before = F.col("start") - lag("end"), lag("start") - lag("end", 2)
    after = lead("start") - F.col("end")
    same, same2, same1 = F.col("label").eqNullSafe(lag("label")), F.col("label").eqNullSafe(lag("label", 2)), F.col("label").eqNullSafe(lead("label"))
    own = F.col("sidx").isNotNull() & (((lag("sidx") == F.col("sidx")) & same & (gap <= SPLIT_GAP)) | (lag("sidx").isNull() & (lag("sidx", 2) == F.col("sidx")) & same & same2 & (gap <= BRIDGE) & (before <= BRIDGE)))
    bridge = F.col("sidx").isNull() & (lag("sidx") == lead("sidx")) & same & same1 & (gap <= BRIDGE) & (after <= BRIDGE)
    x = rows.withColumn("__on", F.coalesce(own | bridge, F.lit(False)))
    return x.withColumn("island", F.sum((~F.col("__on")).cast("int")).over(w) - 1).drop("__on")


def merge_by_script_line(segments: DataFrame) -> DataFrame:
    """One line for each island of (episode_id, line_idx, start, end, en, words, sidx, stext, label). A whole script line takes
    the script's text if what was heard is near it; a piece of one keeps what was heard."""
    x = mark_islands(segments)
    words = F.coalesce("words", F.array().cast(_INTERVALS))
    parts = F.array_sort(F.collect_list(F.struct("line_idx", "en", words.alias("words"))))
    firsts = {c: F.min_by(c, "line_idx").alias(c) for c in ("start", "sidx", "stext", "label")}
    g = x.groupBy("episode_id", "island").agg(*firsts.values(), F.max_by("end", "line_idx").alias("end"), parts.alias("p"))
    w = W.partitionBy("episode_id").orderBy("island")
    before = F.lag("sidx").over(w) == F.col("sidx")
    after = (F.lead("sidx").over(w) == F.col("sidx")) & F.lead("label").over(w).eqNullSafe(F.col("label"))
    g = g.withColumns({"partial": F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), "heard": F.array_join("p.en", " ")})
    whole = F.col("sidx").isNotNull() & (F.coalesce("stext", F.lit("")) != "") & ~F.col("partial")
    g = g.withColumns({"__a": F.array_distinct(norm_words("heard")), "__b": F.array_distinct(norm_words("stext"))})
    text = F.when(whole & (jaccard("__a", "__b") >= 0.4), F.col("stext")).otherwise(F.col("heard"))
    return g.select("episode_id", F.col("island").alias("line_idx"), "start", "end", text.alias("en"), F.flatten("p.words").alias("words"), "sidx", "label", F.size("p").alias("fragments"))


def deadlines(lines: DataFrame, key: str = "episode_id", cell: float = SECONDS) -> DataFrame:
    """Adds ``deadline``, when each of (key, line_idx, onset, dur, total) has to be over. The backward recurrence
    D[k] = min(onset[k+1] + MAX_LAG, D[k+1] - dur[k+1] / MAX_SPEEDUP) - MIN_GAP unrolls: with S[k] the sum of what later
    lines need, D[k] + S[k] is a reverse running minimum.

    Both run from the last line on, so that each row is added once. Lines are dealt by cells of time; a cell takes the sum, the next
    onset and the least bound of those behind it from one row for each."""
    x = lines.where(F.col("dur") > 0).withColumns({"__cell": F.floor(F.col("onset") / cell), "__need": F.col("dur") / MAX_SPEEDUP + MIN_GAP})
    of = [key, "__cell"]
    back = W.partitionBy(*of).orderBy(F.desc("onset"), F.desc("line_idx"))
    behind = W.partitionBy(key).orderBy(F.desc("__cell")).rowsBetween(W.unboundedPreceding, -1)

    def carry(rows: DataFrame, cells: DataFrame) -> DataFrame:
        # keys may be null, and so may onsets
        met = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & F.col("a.__cell").eqNullSafe(F.col("b.__cell"))
        return rows.alias("a").join(cells.alias("b"), met).select("a.*", *[f"b.{c}" for c in cells.columns if c not in of])

    sums = x.groupBy(*of).agg(F.sum("__need").alias("__sum"), F.min("onset").alias("__first"))
    sums = sums.select(*of, F.coalesce(F.sum("__sum").over(behind), F.lit(0.0)).alias("__sum"), F.last("__first").over(behind).alias("__first"))
    x = carry(x, sums).withColumn("__s", F.col("__sum") + F.coalesce(F.sum("__need").over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("__next", F.coalesce(F.lag("onset").over(back), "__first"))
    # the last line's term is the total; S of the last line is 0
    bound = F.when(F.col("__next").isNull(), F.col("total")).otherwise(F.col("__next") + MAX_LAG - MIN_GAP + F.col("__s"))
    x = x.withColumn("__bound", bound)
    least = x.groupBy(*of).agg(F.min("__bound").alias("__least"))
    x = carry(x, least.select(*of, F.min("__least").over(behind).alias("__least")))
    least = F.least(F.min("__bound").over(back.rowsBetween(W.unboundedPreceding, 0)), "__least")
    return x.withColumn("deadline", least - F.col("__s")).drop("__cell", "__need", "__sum", "__first", "__s", "__next", "__bound", "__least")


def plan_timeline(lines: DataFrame, key: str = "episode_id") -> DataFrame:
    """(key, line_idx, place, tempo) of (key, line_idx, onset, dur, total): a line starts on its onset or MIN_GAP after the
    one before, at normal speed unless its deadline forces up to MAX_SPEEDUP. The rounded tempo feeds the next line, so
    this is a fold along the episode's order, scene by scene, one row a scene.

    The fold starts anew at lines that begin on their own onset whatever the tempo before: there all lines before would
    be over even at normal speed. So it runs along short scenes, and its time follows their lengths, not the episode's."""
    order = W.partitionBy(key).orderBy("onset", "line_idx")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    x = deadlines(lines, key).withColumn("__used", F.coalesce(F.sum(F.col("dur") + MIN_GAP).over(earlier), F.lit(0.0)))
    free = F.col("__used") + F.max(F.col("onset") - F.col("__used")).over(earlier)
    x = x.withColumn("__scene", F.coalesce((F.col("onset") >= free + _TINY).cast("int"), F.lit(0)))
    x = x.withColumn("__scene", F.sum("__scene").over(order))
    index, kind = x.schema["line_idx"].dataType.simpleString(), x.schema[key].dataType.simpleString()
    line = F.struct(F.col("onset").cast("double").alias("onset"), "line_idx", F.col("dur").cast("double").alias("dur"), F.col("deadline").cast("double").alias("deadline"))
    scenes = x.groupBy(key, "__scene").agg(F.array_sort(F.collect_list(line)).alias("r")).select(key, "r")

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for of, lines in part.itertuples(index=False):
                end = None
                for r in lines:
                    at = max(r["onset"], 0.0 if end is None else end + MIN_GAP)
                    room = r["deadline"] - at
                    tempo = 1.0 if room >= r["dur"] - 1e-9 else math.floor(min(r["dur"] / max(room, 0.3), MAX_SPEEDUP) * 1e4 + 0.5) / 1e4
                    out.append((of, r["line_idx"], math.floor(at * 1e4 + 0.5) / 1e4, tempo))
                    end = at + r["dur"] / tempo
            yield pd.DataFrame(out, columns=[key, "line_idx", "place", "tempo"])

    return scenes.mapInPandas(place, f"{key} {kind}, line_idx {index}, place double, tempo double")
