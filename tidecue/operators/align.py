"""Order-preserving fuzzy alignment of what was heard with a transcript, and filling its gaps."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, norm_words, round_to
from ..plans.stages import cut, kept
from .blocks import CELLS, LEVELS, matching_blocks, positions

MATCH, NEAR, LEAD = 0.34, 0.30, 0.10
#: The likeness of the best has to reach NEAR and lead by LEAD, so no score up to here changes anything.
LEAST = NEAR - LEAD - 1e-9
#: Unmatched lines of a run times the script lines between its matches, up to which they meet as sets of words.
SHORT = 256


def token_times() -> Column:
    """Times of a line's match words (column ``tokens``) from its ``words``: the k-th of m words takes the time of word
    round(k (W - 1) / (m - 1)), halves to even; without word times the line's span is divided evenly."""
    m, w = F.size("tokens"), F.filter(F.coalesce("words", F.array().cast("array<struct<s:double,e:double>>")), lambda x: x["e"] > x["s"])
    n = F.size(w)
    k = F.when(m > 0, F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.when(m > 1, F.bround(i * (n - 1) / F.greatest(m - 1, F.lit(1)))).otherwise(0).cast("int")
    span = F.greatest(F.col("end") - F.col("start"), F.lit(0.3))
    even = lambda i: F.struct((F.col("start") + span * i / m).alias("s"), (F.col("start") + span * (i + 1) / m).alias("e"))
    return F.when(n > 0, F.transform(k, lambda i: F.get(w, at(i)))).otherwise(F.transform(k, even))


def word_matches(heard: DataFrame, script: DataFrame, levels: tuple[int, ...] = LEVELS, cells: int = CELLS) -> DataFrame:
    """(episode_id, line_idx, sidx, s, e): the words that the two sides share in one common order.

    ``heard`` has episode_id, line_idx, start, end, en, words; ``script`` has episode_id, sidx, text. The matching blocks of
    the whole word sequences decide. Lines without words, and episodes that one side lacks, match nothing."""
    h = kept(heard.select("episode_id", "line_idx", "start", "end", "words", norm_words("en").alias("tokens")))
    said = kept(script.select("episode_id", "sidx", norm_words("text").alias("tokens")))
    size = lambda x, name: x.groupBy("episode_id").agg(F.sum(F.size("tokens")).alias(name)).where(F.col(name) > 0)
    sizes = kept(size(h, "m").join(size(said, "n"), "episode_id"))
    small = F.col("m") * F.col("n") <= cells
    pairs = _whole_matches(h, said, sizes.where(small))
    if not (large := sizes.where(~small).select("episode_id")).isEmpty():
        a = cut(positions(h.join(large, "episode_id", "left_semi"), "episode_id", "line_idx", "tokens"))
        b = cut(positions(said.join(large, "episode_id", "left_semi"), "episode_id", "sidx", "tokens"))
        blocks = matching_blocks(a, b, levels, cells).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("ahi") - F.col("alo") - 1)))
        met = blocks.select("key", (F.col("alo") + F.col("k")).alias("i"), (F.col("blo") + F.col("k")).alias("j"))
        met = met.join(a.select("key", F.col("pos").alias("i"), F.col("owner").alias("line_idx"), "t"), ["key", "i"]).join(b.select("key", F.col("pos").alias("j"), F.col("owner").alias("sidx")), ["key", "j"])
        pairs = pairs.unionByName(met.select(F.col("key").alias("episode_id"), "line_idx", "t", "sidx"))
    timed = pairs.join(h.select("episode_id", "line_idx", token_times().alias("times")), ["episode_id", "line_idx"]).withColumn("time", F.get("times", F.col("t")))
    return timed.select("episode_id", F.col("line_idx").cast("int").alias("line_idx"), F.col("sidx").cast("int").alias("sidx"), F.col("time.s").cast("double").alias("s"), F.col("time.e").cast("double").alias("e"))


def _whole_matches(heard: DataFrame, script: DataFrame, small: DataFrame) -> DataFrame:
    """(episode_id, line_idx, t, sidx): matched words of the episodes ``small``. Their lines meet as arrays of words, so no word of
    theirs becomes a row but a matched one."""

    def side(x: DataFrame, line: str, name: str) -> DataFrame:
        lines = x.where(F.size("tokens") > 0).join(small.select("episode_id"), "episode_id", "left_semi")
        return lines.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct(F.col(line).cast("long").alias("line"), "tokens"))).alias(name))

    both = side(heard, "line_idx", "a").join(side(script, "sidx", "b"), "episode_id")
    both = both.select("episode_id", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("line", "tokens")])
    both = both.where(F.arrays_overlap(F.flatten("a_tokens"), F.flatten("b_tokens")))

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for episode, a_line, a, b_line, b in part.itertuples(index=False):
                size_a, size_b = [len(x) for x in a], [len(x) for x in b]
                line, place, sidx = np.repeat(a_line, size_a), np.concatenate([np.arange(n) for n in size_a]), np.repeat(b_line, size_b)
                for i, j, n in SequenceMatcher(None, list(chain.from_iterable(a)), list(chain.from_iterable(b)), autojunk=False).get_matching_blocks():
                    out += zip([episode] * n, line[i : i + n].tolist(), place[i : i + n].tolist(), sidx[j : j + n].tolist(), strict=True)
            yield pd.DataFrame(out, columns=["episode_id", "line_idx", "t", "sidx"])

    kind = heard.schema["episode_id"].dataType.simpleString()
    return both.mapInPandas(match, f"episode_id {kind}, line_idx long, t int, sidx long")


def best_lines(matches: DataFrame, heard: DataFrame) -> DataFrame:
    """(episode_id, line_idx, sidx) of the lines whose most matched script line has enough of their words; ties go to the
    earlier script line."""
    votes = matches.groupBy("episode_id", "line_idx", "sidx").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("episode_id", "line_idx").agg(F.max_by("sidx", F.struct("n", -F.col("sidx"))).alias("sidx"), F.max("n").alias("n"))
    words = heard.select("episode_id", "line_idx", F.greatest(F.size(norm_words("en")), F.lit(1)).alias("w"))
    return best.join(words, ["episode_id", "line_idx"]).where(F.col("n") / F.col("w") >= MATCH).select("episode_id", "line_idx", "sidx")


def raw_spans(matches: DataFrame) -> DataFrame:
    return matches.groupBy("episode_id", "sidx").agg(F.min("s").alias("onset"), F.max("e").alias("end"), F.count(F.lit(1)).alias("n"))


def anchored_spans(matches: DataFrame, script: DataFrame, least: float = MATCH) -> DataFrame:
    """Where each script line is spoken, if enough of it matched, and two words or a line of four at most."""
    words = script.select("episode_id", "sidx", F.greatest(F.size(norm_words("text")), F.lit(1)).alias("w"))
    x = raw_spans(matches).join(words, ["episode_id", "sidx"])
    x = x.where((F.col("n") / F.col("w") >= least) & ((F.col("n") >= 2) | (F.col("w") <= 4)))
    return x.select("episode_id", "sidx", round_to("onset", 3).alias("onset"), round_to(F.greatest("end", F.col("onset") + 0.3), 3).alias("end"), "n")


def _lowest(prev: Column) -> Column:
    return F.greatest(F.coalesce(prev, F.lit(0)), F.lit(0))


def _highest(after: Column, last: Column) -> Column:
    return F.least(F.coalesce(after, last + 1), last)


def _likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of words; 0 if one is empty."""
    return let(F.size(F.array_intersect(a, b)), lambda c: c / F.greatest(F.size(a) + F.size(b) - c, F.lit(1)))


def _gap_candidates(lines: DataFrame, script: DataFrame) -> DataFrame:
    """Unmatched lines of (episode_id, line_idx, en, sidx) with ``run``, the line at which their run of unmatched lines begins,
    ``prev`` and ``next``, the matched script lines around the run, ``last``, the script's last line, and ``found``, the script lines
    in between with (j, score) that can matter."""
    order = W.partitionBy("episode_id").orderBy("line_idx")
    back, ahead = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    bag = lambda c: F.array_distinct(norm_words(c))
    # sets of words travel, not texts
    x = lines.select("episode_id", "line_idx", bag("en").alias("bag"), "sidx").withColumns({"prev": F.last("sidx", ignorenulls=True).over(back), "next": F.first("sidx", ignorenulls=True).over(ahead)})
    x = x.withColumn("run", F.coalesce(F.last(F.when(F.col("sidx").isNotNull(), F.col("line_idx")), ignorenulls=True).over(back), F.lit(-1))).where("sidx is null").drop("sidx")
    x = x.join(script.groupBy("episode_id").agg((F.count(F.lit(1)) - 1).cast("int").alias("last")), "episode_id")
    lo, hi = _lowest(F.col("prev")), _highest(F.col("next"), F.col("last"))
    runs = x.groupBy("episode_id", "run", lo.alias("lo"), hi.alias("hi")).agg(F.count(F.lit(1)).alias("lines")).where("lo <= hi")
    runs = kept(runs)
    place = F.row_number().over(W.partitionBy("episode_id").orderBy("sidx")) - 1
    said = script.select("episode_id", "sidx", bag("text").alias("words")).select("episode_id", place.alias("j"), "words")
    taken = lambda runs: runs.select("episode_id", "run", F.explode(F.sequence("lo", "hi")).alias("j")).join(said, ["episode_id", "j"])
    short = F.col("lines") * (F.col("hi") - F.col("lo") + 1) <= SHORT
    # the few script lines that a short run may take go to it as sets of words
    near = taken(runs.where(short)).groupBy("episode_id", "run").agg(F.collect_list(F.struct("j", "words")).alias("near"))
    x = x.join(near, ["episode_id", "run"], "left")
    found = F.filter(F.transform("near", lambda y: F.struct(y["j"].alias("j"), _likeness(F.col("bag"), y["words"]).alias("score"))), lambda f: f["score"] > LEAST)
    x = x.withColumn("found", found).drop("near")
    if (long := runs.where(~short)).isEmpty():
        return x.drop("bag")
    # an inverted index of the script lines that a long run may take, and of its own lines
    index = taken(long).select("episode_id", "run", "j", F.size("words").alias("m"), F.explode("words").alias("word"))
    heard = x.join(long.select("episode_id", "run"), ["episode_id", "run"], "left_semi").select("episode_id", "run", "line_idx", F.size("bag").alias("n"), F.explode("bag").alias("word"))
    both = heard.join(index, ["episode_id", "run", "word"]).groupBy("episode_id", "line_idx", "j", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    scored = both.withColumn("score", F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).where(F.col("score") > LEAST)
    more = scored.groupBy("episode_id", "line_idx").agg(F.collect_list(F.struct("j", "score")).alias("more"))
    return x.join(more, ["episode_id", "line_idx"], "left").withColumn("found", F.coalesce("found", "more")).drop("more", "bag")


def _fill_run(prev: int | None, after: int | None, last: int, found: list[list[tuple[int, float]]]) -> list[int | None]:
    """What the lines of one run take, in order; each one taken opens the interval of the next."""
    out: list[int | None] = []
    for candidates in found:
        lo, hi = max(prev if prev is not None else 0, 0), min(last, after if after is not None else last)
        ranked = sorted(((score, j) for j, score in candidates if lo <= j <= hi), reverse=True)[:2]
        take = None
        if ranked and ranked[0][0] >= NEAR and ranked[0][0] >= (ranked[1][0] if len(ranked) > 1 else 0.0) + LEAD:
            take = ranked[0][1]
        elif lo <= hi and prev is not None and after is not None and after - prev in (0, 2):
            take = (prev + after) // 2
        prev = take if take is not None else prev
        out.append(take)
    return out


def fill_gaps(lines: DataFrame, script: DataFrame) -> DataFrame:
    """(episode_id, line_idx, sidx) with gaps filled where the script leaves little doubt.

    ``lines`` has episode_id, line_idx, en, sidx (null: unmatched). An unmatched line looks between the script lines
    before (filled ones count) and after it: the clearly most similar one (the later one of equals), else the one line that is
    missing there, else the line that both sides are part of. ``sidx`` counts the script's lines from 0. Episodes without a
    script stay as they are.

    Scores come from joins; only the lines of one run between two matches, with the few script lines that are near enough,
    are gone through in order."""
    open_lines = _gap_candidates(lines, script)
    line = F.struct("line_idx", F.coalesce("found", F.array().cast("array<struct<j:int,score:double>>")).alias("found"))
    runs = open_lines.groupBy("episode_id", "run").agg(F.first("prev").alias("prev"), F.first("next").alias("next"), F.first("last").alias("last"), F.array_sort(F.collect_list(line)).alias("lines"))
    filled = _filled(runs.withColumn("matched", F.lit(None).cast("int"))).where("sidx is not null").withColumnRenamed("sidx", "filled")
    return lines.join(filled, ["episode_id", "line_idx"], "left").select("episode_id", "line_idx", F.coalesce("sidx", "filled").alias("sidx"))


def _filled(runs: DataFrame) -> DataFrame:
    """(episode_id, line_idx, sidx) of the lines of runs (episode_id, matched, prev, next, last, lines): those in ``lines`` (line_idx,
    found), and before them the matched one, if there is one."""
    kind = runs.schema["episode_id"].dataType.simpleString()

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[tuple] = []
            for episode, matched, prev, after, last, rows in part.itertuples(index=False):
                if not pd.isna(matched):
                    out.append((episode, int(matched), int(prev)))
                got = _fill_run(None if pd.isna(prev) else int(prev), None if pd.isna(after) else int(after), int(last), [[(f["j"], f["score"]) for f in r["found"]] for r in rows])
                out += [(episode, r["line_idx"], j) for r, j in zip(rows, got, strict=True)]
            yield pd.DataFrame(out, columns=["episode_id", "line_idx", "sidx"], dtype=object)

    return runs.select("episode_id", "matched", "prev", "next", "last", "lines").mapInPandas(fill, f"episode_id {kind}, line_idx int, sidx int")


def fill_whole(episodes: DataFrame) -> DataFrame:
    """``fill_gaps`` for episodes that are a row each: ``heard`` is an array of (line_idx, words, sidx) in the lines' order, ``script`` an
    array of the words of each line, as ``norm_words`` has them. Nothing is shuffled, and what grows with a run of unmatched lines
    stays in its row: the lines times the script lines between its matches. Where those may be many, ``fill_gaps`` deals them out."""
    bag = lambda words: F.array_distinct(F.coalesce(words, F.array().cast("array<string>")))
    none = F.array().cast("array<array<string>>")
    sets = F.transform("heard", lambda y: F.struct(y["line_idx"].alias("line_idx"), y["sidx"].alias("sidx"), bag(y["words"]).alias("bag")))
    x = episodes.select("episode_id", sets.alias("heard"), F.coalesce(F.transform("script", bag), none).alias("script"))
    # each run is a matched line, or the first one, and the unmatched lines after it
    begins = F.transform("heard", lambda y, i: F.when((i == 0) | y["sidx"].isNotNull(), i))
    x = x.withColumn("begins", F.filter(begins, lambda i: i.isNotNull()))
    until = lambda k: F.get("begins", k + 1)
    size = lambda i, k: F.coalesce(until(k), F.size("heard")) - i
    run = lambda i, k: F.struct(F.slice("heard", i + 1, size(i, k)).alias("lines"), F.get("heard", i)["sidx"].alias("prev"), F.get("heard", until(k))["sidx"].alias("next"), (F.size("script") - 1).alias("last"))
    between = lambda r: F.struct(_lowest(r["prev"]).alias("lo"), _highest(r["next"], r["last"]).alias("hi"))
    near = lambda r, y: F.struct(r.alias("run"), y["lo"].alias("lo"), F.slice("script", y["lo"] + 1, F.greatest(y["hi"] - y["lo"] + 1, F.lit(0))).alias("near"))
    x = x.select("episode_id", F.explode(F.transform(F.transform("begins", run), lambda r: let(between(r), lambda y: near(r, y)))).alias("r"))
    x = x.select("episode_id", "r.run.prev", "r.run.next", "r.run.last", "r.lo", "r.near", F.col("r.run.lines").alias("all"))
    first = F.get("all", F.lit(0))
    x = x.withColumn("matched", F.when(first["sidx"].isNotNull(), first["line_idx"]))
    score = lambda y, s, i: F.struct((F.col("lo") + i).alias("j"), _likeness(y["bag"], s).alias("score"))
    found = lambda y: F.filter(F.transform("near", lambda s, i: score(y, s, i)), lambda f: f["score"] > LEAST)
    lines = F.transform(F.filter("all", lambda y: y["sidx"].isNull()), lambda y: F.struct(y["line_idx"].alias("line_idx"), found(y).alias("found")))
    return _filled(x.withColumn("lines", lines))


def align(heard: DataFrame, script: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heard lines with sidx, stext and the script's speaker (raw), and the spans of the script lines. The matching is
    computed once; cache it if both results are used."""
    matches = word_matches(heard, script)
    exact = heard.join(best_lines(matches, heard), ["episode_id", "line_idx"], "left")
    filled = fill_gaps(exact, script)
    said = script.select("episode_id", "sidx", F.col("speaker").alias("raw"), F.col("text").alias("stext"))
    lines = exact.withColumnRenamed("sidx", "exact_sidx").join(filled, ["episode_id", "line_idx"], "left").join(said, ["episode_id", "sidx"], "left")
    return lines, anchored_spans(matches, script)
