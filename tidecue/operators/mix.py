"""Mixing: the original steps back under the spoken clips. A track is a table of blocks of samples, of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Level under a clip, ramp in seconds, level of the clips; samples of a block.
LOW, RAMP, VOICE, BLOCK = 0.06, 0.06, 0.95, 1 << 16


def duck(track: np.ndarray, clips: list[tuple[int, int, int, np.ndarray]], rate: int, level: float, first: int = 0, total: int | None = None) -> np.ndarray:
    """The block of a track that starts at sample ``first`` of ``total``, at ``level``, at LOW at most around each clip, the gain
    smoothed by a moving average; clips are added in their order, and the sum stays within -1 and 1.

    A clip is (first sample, end on the track, offset of the samples given, samples); clips that reach to within two ramps of the block
    are needed, samples only for the block. A gain has two levels, so its average follows from how many samples around
    are covered: a whole number, and the same for a block as for the whole track."""
    n, ramp = len(track), max(int(RAMP * rate), 1)
    total = n if total is None else total
    before, behind = ramp // 2, (ramp - 1) // 2
    lo, hi = max(first - before, 0), min(first + n + behind, total)
    # how many clips cover a sample: borders, added up
    border = np.zeros(hi - lo + 1, np.int64)
    for pos, end, _, _ in clips:
        opens, closes = np.clip([max(pos - ramp, 0) - lo, min(end + ramp, total) - lo], 0, hi - lo)
        border[opens] += 1
        border[closes] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(border[:-1]) > 0)])
    at = np.arange(first, first + n)
    left, right = np.maximum(at - before, 0) - lo, np.minimum(at + behind + 1, total) - lo
    low = covered[right] - covered[left]
    smooth = ((low * min(LOW, level) + (right - left - low) * level) / ramp).astype(np.float32)
    voices = np.zeros(n, np.float32)
    for pos, _, offset, samples in clips:
        start = pos + offset - first
        a, b = max(start, 0), min(start + len(samples), n)
        if a < b:
            voices[a:b] += samples[a - start : b - start]
    return (track.astype(np.float32) * smooth + np.float32(VOICE) * voices).clip(-1, 1)


def track_blocks(tracks: DataFrame, size: int = BLOCK) -> DataFrame:
    """(episode_id, block, samples): tracks (episode_id, samples) that still are one value, cut into blocks of ``size`` samples."""
    n = F.greatest(F.ceil(F.size("samples") / size), F.lit(1)).cast("int")
    return tracks.select("episode_id", "samples", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")).select("episode_id", "block", F.slice("samples", F.col("block") * size + 1, F.lit(size)).alias("samples"))


def assemble(blocks: DataFrame, clips: DataFrame, rate: int, level: float, size: int = BLOCK) -> DataFrame:
    """(episode_id, block, samples) of blocks (episode_id, block, samples), all of ``size`` samples but the last, and clips (episode_id,
    clip_idx, start, samples), which count in the order of (start, clip_idx). Clips meet the blocks that they reach, as slices;
    they are cut at the track's end, and those that start behind it do nothing. Only a block is ever in one place."""
    ramp = max(int(RAMP * rate), 1)
    totals = blocks.groupBy("episode_id").agg(F.sum(F.size("samples")).alias("total"))
    c = clips.join(totals, "episode_id").withColumn("pos", F.floor(F.greatest(F.col("start"), F.lit(0.0)) * rate).cast("long")).where("pos < total")
    c = c.withColumn("stop", F.least(F.col("pos") + F.size("samples"), "total"))
    near = F.sequence(F.expr(f"greatest(pos - {2 * ramp}, 0) div {size}"), F.expr(f"(least(stop + {2 * ramp}, total) - 1) div {size}"))
    c = c.withColumn("block", F.explode(near))
    skip = F.greatest(F.col("block") * size - F.col("pos"), F.lit(0))
    take = F.greatest(F.least((F.col("block") + 1) * size, "stop") - F.col("pos") - skip, F.lit(0))
    part = F.slice("samples", (skip + 1).cast("int"), take.cast("int")).cast("array<float>")
    c = c.select("episode_id", F.col("block").cast("int").alias("block"), F.struct("start", "clip_idx", "pos", "stop", skip.alias("skip"), part.alias("part")).alias("clip"))
    c = c.groupBy("episode_id", "block").agg(F.array_sort(F.collect_list("clip")).alias("clips"))
    x = blocks.select("episode_id", F.col("block").cast("int").alias("block"), F.col("samples").cast("array<float>").alias("samples")).join(totals, "episode_id").join(c, ["episode_id", "block"], "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            out = []
            for block, samples, total, own in zip(b["block"], b["samples"], b["total"], b["clips"], strict=True):
                near = [(p["pos"], p["stop"], p["skip"], np.asarray(p["part"], np.float32)) for p in (own if own is not None else [])]
                out.append(duck(np.asarray(samples, np.float32), near, rate, level, block * size, int(total)).tolist())
            yield b[["episode_id", "block"]].assign(samples=out)

    kind = blocks.schema["episode_id"].dataType.simpleString()
    return x.select("episode_id", "block", "samples", "total", "clips").mapInPandas(run, f"episode_id {kind}, block int, samples array<float>")
