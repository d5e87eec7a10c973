"""Matching blocks of two word sequences, for many pairs of sequences at once.

The rule: the longest run of equal words is a block (of equally long ones the first in a, then the first in b), and what lies
before it and behind it is matched in the same way. Long runs decide first, so they are found by joins on runs of
many words, which are rare; what no such run divides is either small, and then matched row by row, or looked at again with
shorter runs. A pair of any length is so split into independent gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import cut

#: Words of the runs that are looked for in turn, and the size (words of a times words of b) up to which a gap is matched at once.
LEVELS, CELLS = (8, 3, 1), 1 << 18
#: Positions that are sorted together.
STRETCH = 4096
_GAP = ["key", "gap", "alo", "ahi", "blo", "bhi"]


def positions(lines: DataFrame, key: str, order: str, tokens: str) -> DataFrame:
    """(key, pos, owner, t, word) of lines (key, order, tokens): all words of a key numbered from 0 on in the lines' order, with
    their line and place in it."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    x = lines.select(F.col(key).alias("key"), F.col(order).alias("owner"), F.col(tokens).alias("w"), F.coalesce(F.sum(F.size(tokens)).over(before), F.lit(0)).alias("first"))
    return x.select("key", "owner", "first", F.posexplode("w").alias("t", "word")).select("key", (F.col("first") + F.col("t")).cast("int").alias("pos"), "owner", "t", "word")


def _within(words: DataFrame, gaps: DataFrame, lo: str, hi: str) -> DataFrame:
    """(key, gap, pos, word) of the words inside of gaps."""
    return gaps.select("key", "gap", F.explode(F.sequence(F.col(lo), F.col(hi) - 1)).alias("pos")).join(words.select("key", "pos", "word"), ["key", "pos"])


def _grams(words: DataFrame, k: int) -> DataFrame:
    """(key, gap, pos, gram, before, after): runs of k words, and the words around them (null at the gap's ends). Words are sorted by
    stretches, to which the words around them are copied, so no gap is sorted whole."""
    home = F.expr(f"pos div {STRETCH}")
    copies = F.array_distinct(F.array(F.expr(f"(pos - {k}) div {STRETCH}"), home, F.expr(f"(pos + 1) div {STRETCH}")))
    x = words.withColumn("stretch", F.explode(copies))
    w = W.partitionBy("key", "gap", "stretch").orderBy("pos")
    # positions of a gap have no holes: k places on is k words on
    run = F.array_join(F.collect_list("word").over(w.rowsBetween(0, k - 1)), " ")
    x = x.withColumns({"gram": run, "before": F.lag("word").over(w), "after": F.lead("word", k).over(w), "whole": F.lead("pos", k - 1).over(w).isNotNull()})
    return x.where(f"whole and stretch = pos div {STRETCH}").select("key", "gap", "pos", "gram", "before", "after")


def _runs(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(key, gap, i, j, n): the longest possible runs of equal words of at least k words in each gap. Only the two ends of each become
    rows: on a diagonal, beginnings and ends take turns."""
    left, right = (_grams(x, k).select("key", "gap", "gram", F.col("pos").alias(p), F.col("before").alias(f"{p}b"), F.col("after").alias(f"{p}a")) for x, p in ((a, "i"), (b, "j")))
    begins, stops = (F.coalesce(F.col(f"i{e}") != F.col(f"j{e}"), F.lit(True)) for e in "ba")
    ends = left.join(right, ["key", "gap", "gram"]).withColumns({"begins": begins, "stops": stops}).where("begins or stops")
    diagonal = W.partitionBy("key", "gap", F.col("i") - F.col("j")).orderBy("i")
    until = F.first(F.when(F.col("stops"), F.col("i")), ignorenulls=True).over(diagonal.rowsBetween(0, W.unboundedFollowing))
    return ends.withColumn("n", until - F.col("i") + k).where("begins").select("key", "gap", "i", "j", "n")


def choose(runs: np.ndarray, gap: tuple[int, int, int, int], least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """(blocks, gaps) of a gap (alo, ahi, blo, bhi) with runs (rows i, j, n): blocks of ``least`` words or more, by the rule, and what
    they leave on both sides, as far as both sequences have words there."""
    blocks, rest, todo = [], [], [(gap, runs)]
    while todo:
        (alo, ahi, blo, bhi), r = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        cut_off = np.maximum(0, np.maximum(alo - r[:, 0], blo - r[:, 1]))
        i, j = r[:, 0] + cut_off, r[:, 1] + cut_off
        n = np.minimum(np.minimum(r[:, 0] + r[:, 2], ahi) - i, np.minimum(r[:, 1] + r[:, 2], bhi) - j)
        live = n >= least
        if not live.any():
            rest.append((alo, ahi, blo, bhi))
            continue
        r, i, j, n = r[live], i[live], j[live], n[live]
        best = np.lexsort((j, i, -n))[0]
        x, y, m = int(i[best]), int(j[best]), int(n[best])
        blocks.append((x, y, m))
        todo += [((alo, x, blo, y), r), ((x + m, ahi, y + m, bhi), r)]
    return blocks, rest


def _level(gaps: DataFrame, a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(key, block, alo, ahi, blo, bhi): the blocks of k words or more of gaps, and the gaps that are left."""
    runs = _runs(_within(a, gaps, "alo", "ahi"), _within(b, gaps, "blo", "bhi"), k)
    met = gaps.join(runs, ["key", "gap"], "left")
    kind = gaps.schema["key"].dataType.simpleString()

    def divide(x: pd.DataFrame) -> pd.DataFrame:
        row = x.iloc[0]
        found = x[["i", "j", "n"]].dropna().to_numpy(dtype=np.int64)
        blocks, rest = choose(found, tuple(int(row[c]) for c in _GAP[2:]), k)
        out = [(row["key"], True, i, i + n, j, j + n) for i, j, n in blocks] + [(row["key"], False, *g) for g in rest]
        return pd.DataFrame(out, columns=["key", "block", *_GAP[2:]])

    return met.groupBy("key", "gap").applyInPandas(divide, f"key {kind}, block boolean, alo int, ahi int, blo int, bhi int")


def _at_once(gaps: DataFrame, a: DataFrame, b: DataFrame, whole: bool) -> DataFrame:
    """(key, alo, ahi, blo, bhi): all blocks of small gaps, one gap a row. Gaps that are ``whole`` sequences need no positions."""
    inside = lambda words, lo, hi: words.join(gaps.select("key", "gap"), "key") if whole else _within(words, gaps, lo, hi)
    side = lambda words, lo, hi, name: inside(words, lo, hi).groupBy("key", "gap").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias(name))
    x = side(a, "alo", "ahi", "a").join(side(b, "blo", "bhi", "b"), ["key", "gap"]).where(F.arrays_overlap("a.word", "b.word"))
    kind = gaps.schema["key"].dataType.simpleString()
    x = x.select("key", F.col("a.pos")[0].alias("alo"), F.col("b.pos")[0].alias("blo"), F.col("a.word").alias("a"), F.col("b.word").alias("b"))

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, i0, j0, x, y in part.itertuples(index=False):
                found = SequenceMatcher(None, list(x), list(y), autojunk=False).get_matching_blocks()
                out += [(key, i0 + i, i0 + i + n, j0 + j, j0 + j + n) for i, j, n in found if n]
            yield pd.DataFrame(out, columns=["key", *_GAP[2:]])

    return x.mapInPandas(match, f"key {kind}, alo int, ahi int, blo int, bhi int")


def matching_blocks(a: DataFrame, b: DataFrame, levels: tuple[int, ...] = LEVELS, cells: int = CELLS) -> DataFrame:
    """(key, alo, ahi, blo, bhi): the blocks of the sequences a and b (key, pos, word) of each key; words alo to ahi - 1 of a equal
    words blo to bhi - 1 of b. Positions of a key have no holes and start at 0. A key that one side lacks has no blocks.

    The last level must be 1: then no two equal words are left in a gap. A gap of any size is divided by joins, and only its
    runs of equal words, not its words, meet in one task."""
    size = lambda x, name: x.groupBy("key").agg((F.max("pos") + 1).alias(name))
    whole = size(a, "ahi").join(size(b, "bhi"), "key")
    gaps = cut(whole.select("key", F.lit(0).alias("gap"), F.lit(0).alias("alo"), "ahi", F.lit(0).alias("blo"), "bhi"))
    found: list[DataFrame] = []
    small = (F.col("ahi") - F.col("alo")).cast("long") * (F.col("bhi") - F.col("blo")) <= cells
    for n, k in enumerate(levels):
        found.append(_at_once(gaps.where(small), a, b, whole=n == 0))
        large = gaps.where(~small)
        if large.isEmpty():
            break
        divided = cut(_level(large, a, b, k))
        found.append(divided.where("block").drop("block"))
        gaps = divided.where("not block").select("key", F.col("alo").alias("gap"), *_GAP[2:])
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
