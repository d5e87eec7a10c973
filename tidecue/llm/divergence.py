"""How far the sources of each language differ in their words: wide term vectors, exact whole-number divergences.

Per language, each kept term becomes a vector indexed by source. A source that lacks the term has the same share for all such
terms, so a vector holds the sources that have it, and what the others add is counted in closed form:
for sources i and j, with shares p, shares z of a term that is absent, and f the divergence of two shares,

    sum f(p_i, p_j) over all terms =
        sum of f(p_i, p_j) - f(p_i, z_j) - f(z_i, p_j) + f(z_i, z_j) over terms that both have
        + sum of f(p_i, z_j) over terms that i has + sum of f(z_i, p_j) over terms that j has
        + (V - n_i - n_j) f(z_i, z_j)

with V terms, n_i of them in i. The first sum is what the vectors emit, pair by pair; the next two need only how many terms
have each share in a source. All of it is whole numbers, so the order of summing does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import forget, materialize
from ._tok import chunks

#: Documents of a language that a term has to be in, and how many terms each source reports.
MIN_DOCS, TERMS = 10, 10
#: Groups up to this number are sent to all tasks (about 100 bytes each); more are joined by shuffles.
GROUPS, SALTS = 20_000, 64
#: Bytes of text whose terms are counted at once.
CHUNK = 1 << 22
#: Bytes of terms: ASCII letters and all beyond ASCII.
_TERM = np.array([(65 <= c <= 90) or (97 <= c <= 122) or c >= 128 for c in range(256)])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): of some documents, how often a term occurs in those of a group, and in how many. Rows
    of the same group and term come from different chunks and still have to be added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            group = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
            for c in chunks(batch, lower=True, size=CHUNK, inside=_TERM):
                letters, offsets = c.data[_TERM[c.data]], np.zeros(len(c.starts) + 1, np.int64)
                np.cumsum(c.ends - c.starts, out=offsets[1:])
                term = pa.Array.from_buffers(pa.large_string(), len(c.starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
                n = len(term.dictionary)
                if not n:
                    continue
                row = np.repeat(np.arange(c.hi - c.lo), np.diff(c.first))
                once, times = np.unique(row * n + np.asarray(term.indices), return_counts=True)
                both, at = np.unique(group[c.lo + once // n] * n + once % n, return_inverse=True)
                total, documents = (np.bincount(at, weights, minlength=len(both)).astype(np.int64) for weights in (times, None))
                names = [lang.dictionary.take(pa.array(both // n // len(source.dictionary))), source.dictionary.take(pa.array(both // n % len(source.dictionary))), term.dictionary.take(pa.array(both % n)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(pc.cast(x, pa.string()) for x in names), pa.array(total), pa.array(documents)], ["lang", "source", "term", "n", "docs"])

    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10**9 (n + 2) / (size + 2 terms)); products pass 64 bits, so they are decimals."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", whole(n + 2) * F.lit(10**9).cast("decimal(10,0)"), whole(F.greatest(size + 2 * terms, F.lit(1)))) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str], spread: str, n_groups: int) -> DataFrame:
    """``rows`` with the columns of their group. A language or a source can have any share of the rows: beyond GROUPS groups,
    rows are spread over SALTS copies of a group by ``spread``."""
    if n_groups <= GROUPS:
        return rows.join(F.broadcast(groups), on)
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [*on, "salt"]).drop("salt")


def source_divergence(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair`` has each other source of the language and the divergence from it over
    all kept terms; part ``term`` has the ``terms`` terms in which the source exceeds its language most.

    A term is a run of characters other than ASCII ones that are no letters, A-Z lower-cased; a language keeps the terms in
    ``min_docs`` of its documents (rows) at least. Null texts, languages and sources are empty ones; every language and source that
    occurs counts, also without a text or a term: where a language keeps no term, all its pairs have value 0. Equal values are
    ranked by item in the order of bytes. Repeated rows are documents of their own, very long texts are counted in one task,
    columns besides text, lang and source play no part, and an empty table gives an empty result.

    Terms are counted on the map side by chunk, then by task. A vector holds no more entries than its language has sources, and
    its pairs are emitted one first source at a time, so no array of pairs is ever built; sums are taken on the map side.
    """
    counted = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("sources"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = materialize(spark, kept.where(F.col("docs") >= min_docs).drop("docs"), "kept_terms")

    # sizes: N of each group and language, V of each language, and each source's place among those of its language
    sizes = kept.select("lang", F.explode("sources").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("size"), F.count(F.lit(1)).alias("present"))
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    occurring = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = occurring.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left").select("lang", "source", *map(zero, ("size", "present", "v", "lang_size")))
    groups = groups.withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy("source"))).withColumn("z", _share(F.lit(0).cast("long"), F.col("size"), F.col("v")))
    groups = materialize(spark, groups, "groups")
    n_groups = groups.count()

    cells = kept.select("lang", "term", "total", F.explode("sources").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    cells = _with_groups(cells, groups, ["lang", "source"], "term", n_groups)
    cells = cells.select("lang", "source", "term", "i", "z", _share(F.col("n"), F.col("size"), F.col("v")).alias("p"), _share(F.col("total"), F.col("lang_size"), F.col("v")).alias("q"))
    cells = materialize(spark, cells, "cells")

    # pairs of sources that both have the term
    wide = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("i", "p", "z"))).alias("w"))
    each = wide.select("lang", "w", F.posexplode("w").alias("k", "a"))
    more = lambda b: _f(F.col("a.p"), b["p"]) - _f(F.col("a.p"), b["z"]) - _f(F.col("a.z"), b["p"]) + _f(F.col("a.z"), b["z"])
    emitted = F.transform(F.slice("w", F.col("k") + 2, F.size("w")), lambda b: F.struct(b["i"].alias("j"), more(b).alias("value")))
    shared = each.select("lang", F.col("a.i").alias("i"), F.explode(emitted).alias("x")).groupBy("lang", "i", F.col("x.j").alias("j")).agg(F.sum("x.value").alias("value"))
    # terms that one of them has, by share
    shares = cells.groupBy("lang", "i", "p").agg(F.count(F.lit(1)).alias("terms"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "i", "z", "present")).alias("others"))
    other = lambda rows: _with_groups(rows, others, ["lang"], "i", n_groups).withColumn("y", F.explode("others")).where("y.i <> i")
    single = other(shares).groupBy("lang", "i", F.col("y.i").alias("j")).agg(F.sum(F.col("terms") * _f(F.col("p"), F.col("y.z"))).alias("value"))
    # all pairs, as if all terms were absent from both
    absent = F.when(F.col("v") > 0, (F.col("v") - F.col("present") - F.col("y.present")) * _f(F.col("z"), F.col("y.z"))).otherwise(0)
    bare = other(groups.repartition("lang", "source")).select("lang", "i", F.col("y.i").alias("j"), absent.alias("value"), "source", F.col("y.source").alias("item"))
    turned = lambda x: x.unionByName(x.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    pairs = bare.unionByName(turned(shared).unionByName(turned(single)), allowMissingColumns=True)
    pairs = pairs.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.max("source").alias("source"), F.max("item").alias("item"))

    best = [F.col("value").desc(), F.col("item")]
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(*best))
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank)
    high = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    high = high.withColumn("rank", rank).where(F.col("rank") <= terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = materialize(spark, pairs.select(*columns).unionByName(high.select(*columns)), "divergence")
    forget(spark, kept, groups, cells)
    return out
