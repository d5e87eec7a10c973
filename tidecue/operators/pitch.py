"""Pitch of whole recordings: frames cut from blocks of samples, one pitch a frame, an exact median."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import exact_quantiles
from .voices import ENOUGH, FRAME, STEP, voiced_pitches


def frames_of(blocks: DataFrame, size: int, hop: int, block: int) -> DataFrame:
    """(episode_id, frame, samples): every ``hop`` samples ``size`` of them, of blocks (episode_id, block, samples) with ``block`` samples each
    but for the last. A block hands each frame the slice that lies in it, so a track of any length is never in one place. The frame
    that would end with the track's last sample is left out."""
    b0 = F.col("block") * block
    first = F.greatest(F.ceil((b0 - size + 1) / hop), F.lit(0)).cast("long")
    x = blocks.where(F.size("samples") > 0).withColumn("frame", F.explode(F.sequence(first, F.floor((b0 + F.size("samples") - 1) / hop).cast("long"))))
    lo = F.greatest(F.col("frame") * hop - b0, F.lit(0))
    hi = F.least(F.col("frame") * hop + size - b0, F.size("samples"))
    x = x.select("episode_id", "frame", F.struct("block", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part")).alias("p"))
    x = x.groupBy("episode_id", "frame").agg(F.flatten(F.array_sort(F.collect_list("p"))["part"]).alias("samples"))
    totals = blocks.groupBy("episode_id").agg(F.sum(F.size("samples")).alias("__n"))
    return x.join(totals, "episode_id").where(F.col("frame") * hop < F.col("__n") - size).drop("__n")


def frame_table(blocks: DataFrame, rate: int, block: int, low: float = 70.0, high: float = 500.0) -> DataFrame:
    """(episode_id, frame, f0) of frames of 40 ms every 20 ms: the frequency with the largest autocorrelation between the bounds, null for
    quiet and aperiodic frames. A frame is quiet against the loudest sample of its track."""
    size, hop = int(FRAME * rate), int(STEP * rate)
    peaks = blocks.groupBy("episode_id").agg(F.max(F.array_max(F.transform("samples", lambda v: v.cast("double") * v.cast("double")))).alias("peak"))
    x = frames_of(blocks, max(size, 1), max(hop, 1), block).join(peaks, "episode_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            f0 = voiced_pitches(np.stack(b["samples"]).astype(np.float64), b["peak"].to_numpy(), rate, low, high) if len(b) else np.zeros(0)
            yield b[["episode_id", "frame"]].assign(f0=pd.Series(f0, b.index, "float64").astype(object).where(~np.isnan(f0), None))

    kind = blocks.schema["episode_id"].dataType.simpleString()
    return x.where(F.lit(size >= 8 and hop >= 1)).select("episode_id", "frame", "samples", "peak").mapInPandas(run, f"episode_id {kind}, frame long, f0 double")


def track_pitches(blocks: DataFrame, rate: int, block: int, high: float = 500.0) -> DataFrame:
    """(episode_id, f0, frames): the median pitch of each recording's voiced frames; null with fewer than ENOUGH of them."""
    found = exact_quantiles(frame_table(blocks, rate, block, high=high), ["episode_id"], "f0", {"median": 0.5}, cell=1.0)
    x = blocks.select("episode_id").distinct().join(found, "episode_id", "left").withColumn("frames", F.coalesce("n", F.lit(0)).cast("long"))
    return x.select("episode_id", F.when(F.col("frames") >= ENOUGH, F.col("median")).alias("f0"), "frames")
