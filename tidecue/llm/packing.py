"""Packing by length: optimal bucket boundaries from the global histogram, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import materialize

BUCKETS, BUDGET = 8, 65536


def word_count(text: Column | str) -> Column:
    """Words of a text, null as 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def optimal_boundaries(edges: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most k of ``edges`` (ascending lengths) as bucket boundaries, the last one among them, so that the sum over
    rows of the smallest boundary that holds them is least. Dynamic programming: the best of j buckets that end at
    an edge extends the best of j - 1 that end before it. Ties go to fewer and to smaller boundaries.

    The first best place to extend never moves back as the edge grows (moving both ends past each other costs more),
    so each level halves the edges and searches between the places of its neighbours: O(k n log n) for n lengths."""
    n = len(edges)
    if not n:
        return []
    # whole numbers: sums of padded lengths stay exact
    edges = np.asarray(edges).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    best = edges * total[1:]
    back = [np.zeros(n, int)]
    finals = [best[-1]]
    for level in range(1, min(k, n)):
        now, came = np.full(n, np.iinfo(np.int64).max), np.zeros(n, int)
        # edge j as the end of bucket ``level`` has as many edges before it at least
        todo = [(level, n - 1, level - 1, n - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            end = min(j - 1, last)
            options = best[first : end + 1] + edges[j] * (total[j + 1] - total[first + 1 : end + 2])
            came[j] = first + int(np.argmin(options))
            now[j] = options[came[j] - first]
            todo += [(lo, j - 1, first, came[j]), (j + 1, hi, came[j], last)]
        best = now
        back.append(came)
        finals.append(best[-1])
    used, at, out = int(np.argmin(finals)), n - 1, []
    for level in range(used, -1, -1):
        out.append(int(edges[at]))
        at = back[level][at]
    return out[::-1]


def pack(spark: SparkSession, rows: DataFrame, length: Column, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id") -> DataFrame:
    """One row per row of ``rows``: doc_id, n_tokens, bucket, bucket_tokens (what each of its rows is padded to),
    batch (numbered within the bucket), slot (place in the batch), padding.

    A batch holds as many rows as fit ``budget`` at the bucket's length, one at least. Rows without tokens are in no
    batch: their bucket, batch, slot and padding are null. Rows may share a key or have a null one; equal rows are
    interchangeable. An empty table gives an empty result.

    Only the histogram, a row for each distinct length, reaches the driver. Rows are numbered within shards, the rows that one task measured, and
    the table of lengths keeps each one's shard. Offsets add up the shards' sizes, so neither a bucket nor a key, a null
    one included, with any share of the rows is ever in one task. Very long texts are rows like others: only their length goes on.
    """
    sized = materialize(spark, rows.select(F.col(key).alias("doc_id"), length.cast("long").alias("n_tokens"), F.spark_partition_id().alias("shard")), "lengths")
    live = sized.where("n_tokens > 0")
    bins = live.groupBy(F.col("n_tokens").alias("edge")).agg(F.count(F.lit(1)).alias("n")).orderBy("edge").collect()
    bounds = optimal_boundaries(np.array([r["edge"] for r in bins], dtype=np.int64), np.array([r["n"] for r in bins], dtype=np.int64), buckets)
    empty = [F.lit(None).cast("int").alias("bucket"), *[F.lit(None).cast("long").alias(c) for c in ("bucket_tokens", "batch", "slot", "padding")]]
    if not bounds:
        return sized.select("doc_id", "n_tokens", *empty)
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    live = live.withColumn("bucket", bucket)
    before = W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offset = live.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n")).select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    placed = live.withColumn("place", place).join(offset, ["bucket", "shard"]).withColumn("place", F.col("place") + F.col("offset"))
    size = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    fits = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div bucket_tokens"))
    placed = placed.withColumn("bucket_tokens", size).withColumn("fits", fits)
    placed = placed.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.expr("place div fits").alias("batch"), F.expr("place % fits").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
    return placed.unionByName(sized.where("n_tokens <= 0 or n_tokens is null").select("doc_id", "n_tokens", *empty))
