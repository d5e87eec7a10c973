"""Chroma audio fingerprints: filters over an integral image of pitch-class frames, aligned by offset histograms."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialize, n_parts
from ._tok import binary, ids

FRAME, HOP = 256, 64
#: Widest filter in frames; a fingerprint has a 32-bit integer for each frame but the last WIDE - 1.
WIDE = 16
#: Largest share of differing bits of an alignment, and the integers that it must last (or all, of shorter recordings).
ERROR, OVERLAP = 0.2, 24
#: Share of differing bits around a single equal integer, up to which its offset is looked at.
NEARBY = 0.3
#: Recordings and integers of a data block, data blocks of a shard, recordings of a query block, equal integers that are counted at a time,
#: samples of recordings that are transformed together.
ROWS, BLOCK_INTS, SHARD, QUERIES, VOTES, SAMPLES = 16384, 1 << 20, 4, 256, 1 << 20, 1 << 19

Decode = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, int]]]


def filters() -> list[tuple[int, int, int, int]]:
    """The 16 filters by rule: (kind, first pitch class, pitch classes, frames). Kinds: 0 lower against upper half,
    1 earlier against later half, 2 one diagonal against the other, 3 middle against outer pitch classes, 4 middle
    against outer frames."""
    return [(i % 5, (5 * i) % (13 - (h := 4 + 2 * (i % 3))), h, (4, 8, 12, 16)[i % 4]) for i in range(16)]


def pitch_classes(samples: np.ndarray, rate: int, low: float = 60.0) -> np.ndarray:
    """12 energies for each frame, smoothed over five frames and of unit length; silence gives zeros."""
    return _chroma(np.asarray(samples)[None], rate, low)[0]


def _chroma(samples: np.ndarray, rate: int, low: float = 60.0) -> np.ndarray:
    """``pitch_classes`` of recordings of one length, a row each."""
    many, length = samples.shape
    if length < FRAME:
        return np.zeros((many, 0, 12), np.float32)
    hz = np.arange(FRAME // 2 + 1) * rate / FRAME
    use = hz >= low
    note = np.round(12 * np.log2(np.maximum(hz, 1) / 440)).astype(int) % 12
    to = np.zeros((len(hz), 12), np.float32)
    to[np.arange(len(hz))[use], note[use]] = 1
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, ::HOP]
    window, chroma = np.hanning(FRAME).astype(np.float32), np.zeros((many, frames.shape[1], 12), np.float32)
    step = max(1, SAMPLES // (FRAME * many))
    for lo in range(0, frames.shape[1], step):
        turned = np.fft.rfft(frames[:, lo : lo + step].astype(np.float32) * window, axis=2)
        chroma[:, lo : lo + step] = (turned.real**2 + turned.imag**2).astype(np.float32) @ to
    taps = np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)
    padded = np.pad(chroma, ((0, 0), (2, 2), (0, 0)), mode="edge")
    chroma = sum(t * padded[:, i : i + chroma.shape[1]] for i, t in enumerate(taps))
    norm = np.sqrt((chroma**2).sum(axis=2, keepdims=True))
    return np.where(norm > 1e-6, chroma / np.maximum(norm, 1e-12), 0)


def fingerprint(chroma: np.ndarray, step: float = 0.15) -> np.ndarray:
    """One packed integer for each place of the widest filter: each filter's log ratio in two Gray-coded bits."""
    return _integers(chroma[None], step)[0]


def _integers(chroma: np.ndarray, step: float = 0.15) -> np.ndarray:
    """``fingerprint`` of recordings of one length, a row each."""
    many, frames, _ = chroma.shape
    n = frames - WIDE + 1
    if n <= 0:
        return np.zeros((many, 0), np.uint32)
    # rows of the image are pitch classes, so that an area is four runs of memory
    image = np.zeros((13, many, frames + 1))
    image[1:, :, 1:] = np.cumsum(np.cumsum(chroma.transpose(2, 0, 1), axis=2, dtype=np.float64), axis=0)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        band = image[y1] - image[y0]
        return band[:, t1 : t1 + n] - band[:, t0 : t0 + n]

    # log((1 + a) / (1 + b)) against a level is (1 + a) against a multiple of (1 + b)
    up, down = math.exp(step), math.exp(-step)
    out = np.zeros((many, n), np.uint32)
    for kind, y, h, w in filters():
        whole = area(0, w, y, y + h)
        if kind == 0:
            a = area(0, w, y, y + h // 2)
        elif kind == 1:
            a = area(0, w // 2, y, y + h)
        elif kind == 2:
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 3:
            a = area(0, w, y + h // 4, y + h - h // 4)
        else:
            a = area(w // 4, w - w // 4, y, y + h)
        a += 1
        rest = 2 + whole - a
        level = (a > down * rest).astype(np.uint32) + (a > rest) + (a > up * rest)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def fingerprints_of(media: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """The integers of decoded recordings; those of one length and rate go through the transforms together."""
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (x, rate) in enumerate(media):
        alike.setdefault((len(x), rate), []).append(i)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(media)
    for (length, rate), rows in alike.items():
        for lo in range(0, len(rows), step := max(1, SAMPLES // max(1, 4 * length))):
            part = rows[lo : lo + step]
            for i, x in zip(part, _integers(_chroma(np.stack([media[i][0] for i in part]), rate)), strict=True):
                out[i] = x
    return out


def bit_error(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where x[i] meets y[i + offset], and over how many integers."""
    a, b = max(0, -offset), min(len(x), len(y) - offset)
    if b <= a:
        return 1.0, 0
    return float(np.bitwise_count(x[a:b] ^ y[a + offset : b + offset]).sum()) / (32 * (b - a)), b - a


def pcm16(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
    """The default decoder: columns pcm (binary, 16-bit little endian mono) and rate (samples a second)."""
    for raw, rate in zip(ids(batch, "pcm").to_pylist(), ids(batch, "rate").to_pylist(), strict=True):
        raw = raw or b""
        yield np.frombuffer(raw[: len(raw) // 2 * 2], "<i2"), rate or 1


def melody(vector: str, rate: int = 2048, note: int = 128, notes: slice = slice(None), noise: float = 0.0) -> Decode:
    """A decoder that plays a numeric vector: each component is a note whose pitch follows its value (24 semitones
    from 220 Hz over three standard deviations to each side). ``notes`` chooses an excerpt, and ``noise`` adds white noise
    of that standard deviation, the same for the same vector every time."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        time = np.arange(note) / rate
        tones = np.sin(2 * np.pi * (220 * 2 ** (np.arange(24) / 12))[:, None] * time).astype(np.float32)
        for v in ids(batch, vector).to_pylist():
            v = np.nan_to_num(np.array(v or [], dtype=np.float64))
            if not v.any():
                yield np.zeros(0, np.float32), rate
                continue
            z = v / np.abs(v).max()
            pitch = np.clip(np.floor((z / np.sqrt((z**2).mean()) + 3) * 4), 0, 23).astype(int)
            x = tones[pitch[notes]].ravel()
            if noise:
                x = x + noise * np.random.default_rng(zlib.crc32(v.tobytes())).standard_normal(len(x), np.float32)
            yield x, rate

    return run


def _prints(key: str, decode: Decode) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, got, held = batch.slice(lo, 256), [], []
                for x in decode(part):
                    held.append(x)
                    if sum(len(y) for y, _ in held) > 4 * SAMPLES:
                        got, held = got + fingerprints_of(held), []
                got += fingerprints_of(held)
                yield pa.RecordBatch.from_arrays([ids(part, key), pa.array([len(g) for g in got], pa.int64()), binary([g.tobytes() for g in got]), pa.array([hashlib.sha256(g.tobytes()).hexdigest() for g in got], pa.string())], ["rec_id", "n_ints", "ints", "sha256"])

    return run


def fingerprints(table: DataFrame, key: str = "rec_id", columns: tuple[str, ...] = ("pcm", "rate"), decode: Decode = pcm16) -> DataFrame:
    """One row per row of ``table``: rec_id, n_ints, ints (binary, 32-bit little endian), sha256 of them. Null, silent and
    short media have no or constant integers; a null key stays null."""
    return table.select(F.col(key).cast("long").alias(key), *columns).mapInArrow(_prints(key, decode), "rec_id long, n_ints long, ints binary, sha256 string")


def _changes(ints: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places whose integer is not the one before in its recording. Only these vote: a held tone or silence has one
    vote, however long it lasts."""
    new = np.ones(len(ints), bool)
    new[1:] = ints[1:] != ints[:-1]
    new[first[:-1][first[:-1] < len(ints)]] = True
    return np.flatnonzero(new)


def _blocks(rows: int, indexed: bool) -> Callable:
    """Blocks of up to ``rows`` recordings and about BLOCK_INTS integers (a longer recording makes its own); with the places
    that vote in order of their integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, raw = np.asarray(ids(batch, "n_ints")), np.asarray(ids(batch, "rec_id")), ids(batch, "ints")
            ends = np.cumsum(n)
            hi = 0
            while hi < batch.num_rows:
                lo, hi = hi, min(hi + rows, max(hi + 1, int(np.searchsorted(ends, (ends[hi - 1] if hi else 0) + BLOCK_INTS, side="right"))))
                ints = b"".join(raw[i].as_py() for i in range(lo, hi))
                order = b""
                if indexed:
                    x = np.frombuffer(ints, np.uint32)
                    at = _changes(x, np.concatenate([[0], np.cumsum(n[lo:hi])]))
                    order = at[np.argsort(x[at], kind="stable")].astype(np.int32).tobytes()
                arrays = [key[lo:hi].tobytes(), n[lo:hi].tobytes(), ints, order]
                yield pa.RecordBatch.from_arrays([pa.array([int(key[lo])]), *[binary([x]) for x in arrays]], ["block", "keys", "sizes", "ints", "order"])

    return run


def best_run(errors: np.ndarray) -> tuple[int, int]:
    """The longest run of integers with a mean of at most ERROR differing bits of 32, as (start, end)."""
    p = np.concatenate([[0.0], np.cumsum(errors - 32 * ERROR)])
    least = np.minimum.accumulate(p[::-1])[::-1]  # of p from each place on
    end = np.searchsorted(least, p + 1e-9, side="right") - 1
    start = int(np.argmax(end - np.arange(len(p))))
    return start, int(end[start])


@dataclass
class Index:
    """Recordings of a block. ``order`` has the places that vote, by their integers."""

    keys: np.ndarray
    sizes: np.ndarray
    ints: np.ndarray
    order: np.ndarray

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.values = self.ints[self.order]

    def votes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(recording, offset, votes, a place of the query that votes) of every offset that some equal integers name."""
        asked = _changes(q, np.array([0, len(q)]))
        lo, hi = np.searchsorted(self.values, q[asked]), np.searchsorted(self.values, q[asked], side="right")
        far, many = int(self.sizes.max(initial=0)) + len(q) + 1, np.cumsum(hi - lo)
        kept: list[tuple[np.ndarray, ...]] = []
        start = 0
        while start < len(asked):
            stop = max(start + 1, int(np.searchsorted(many, (many[start - 1] if start else 0) + VOTES, side="right")))
            n = (hi - lo)[start:stop]
            at = self.order[np.repeat(lo[start:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
            place = np.repeat(asked[start:stop], n)
            rec = np.searchsorted(self.first, at, side="right") - 1
            code, one, count = np.unique(rec * (2 * far) + at - self.first[rec] - place + far, return_index=True, return_counts=True)
            kept.append((code, count, place[one]))
            start = stop
        if not kept:
            return (np.zeros(0, np.int64),) * 4
        code, count, place = (np.concatenate([k[j] for k in kept]) for j in range(3))
        found, one, which = np.unique(code, return_index=True, return_inverse=True)
        return found // (2 * far), found % (2 * far) - far, np.bincount(which, weights=count).astype(np.int64), place[one]

    def align(self, q: np.ndarray, without: int | None = None) -> list[tuple[int, int, float, int]]:
        """(recording, offset, bit error, integers) of each recording of the block that aligns with a query.

        Every offset in the histogram that several integers name is confirmed, and one that a single integer names if the
        bits around it agree. The longest run of low error at the offset counts; of several offsets the one with most
        agreeing bits (beyond chance), then most votes, then nearest zero."""
        rec, offset, votes, place = self.votes(q)
        ok = self.keys[rec] != without if without is not None else np.ones(len(rec), bool)
        rec, offset, votes, place = rec[ok], offset[ok], votes[ok], place[ok]
        if not len(rec):
            return []
        # bits around one of the equal integers, where both have them
        near = place[:, None] + np.arange(-(OVERLAP // 2), OVERLAP // 2)
        other = near + offset[:, None]
        inside = (near >= 0) & (near < len(q)) & (other >= 0) & (other < self.sizes[rec][:, None])
        bits = np.bitwise_count(q[np.where(inside, near, 0)] ^ self.ints[np.where(inside, other, 0) + self.first[rec][:, None]])
        ok = (votes > 1) | ((bits * inside).sum(axis=1) <= 32 * NEARBY * inside.sum(axis=1))
        best: dict[int, tuple] = {}
        for r, o, v in zip(rec[ok].tolist(), offset[ok].tolist(), votes[ok].tolist(), strict=True):
            a, b = max(0, -o), min(len(q), int(self.sizes[r]) - o)
            y = self.ints[self.first[r] : self.first[r + 1]]
            errors = np.bitwise_count(q[a:b] ^ y[a + o : b + o]).astype(np.int64)
            start, end = best_run(errors)
            over = end - start
            if over >= min(OVERLAP, len(q), len(y)):
                error = float(errors[start:end].sum()) / (32 * over)
                found = (-over * (1 - 2 * error), -v, abs(o), o, error, over)
                best[r] = min(best.get(r, found), found)
        return [(int(self.keys[r]), x[3], x[4], x[5]) for r, x in best.items()]


_FOUND = pa.struct([("less", pa.float64()), ("id", pa.int64()), ("offset", pa.int64()), ("error", pa.float64()), ("overlap", pa.int64())])


def _search(own: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(ids(batch, name)[i].as_buffer(), kind)  # noqa: B023, E731
                index = Index(get("keys", np.int64), get("sizes", np.int64), get("ints", np.uint32), get("order", np.int32))
                first, q = np.concatenate([[0], np.cumsum(get("q_sizes", np.int64))]), get("q_ints", np.uint32)
                rows = []
                for j, key in enumerate(get("q_keys", np.int64).tolist()):
                    got = index.align(q[first[j] : first[j + 1]], None if own else key)
                    if got:
                        found = [{"less": -n * (1 - 2 * e), "id": k, "offset": o, "error": e, "overlap": n} for k, o, e, n in got]
                        rows.append((key, len(got), min(found, key=lambda x: tuple(x.values()))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], _FOUND)], ["rec_id", "n", "best"])

    return run


def identify(spark: SparkSession, prints: DataFrame, queries: DataFrame, own: bool = False) -> DataFrame:
    """Of each query that aligns with a recording: rec_id, n_matches, best_id, best_offset (of the query's first integer in
    it), best_error, best_overlap (integers that agree).

    Both tables are in the form of ``fingerprints``. Integers that a query shares with a recording vote for the
    offset between them; an offset is confirmed by the bit errors of its best run. The best match has most agreeing
    bits, then the smallest id. A query does not meet recordings of its own id unless ``own``. Rows that share an id and
    have the same integers are one recording; with other integers they are further recordings, and n_matches counts
    pairs of such recordings. Recordings without integers and null ids take no part. Silence and held tones are runs of one integer, which
    has one vote. Very long recordings make blocks of their own. By definition an alignment has an equal integer: chance
    ones as short and as wrong as OVERLAP and ERROR allow may have none, and are none.

    A block of queries meets every block of recordings once, through an equi-join on a shard number, and gives one
    row for each query that matches: matches never leave the block one by one.
    """
    live = lambda df: df.where("rec_id is not null and n_ints > 0").groupBy("rec_id", "n_ints", "sha256").agg(F.first("ints").alias("ints"))
    kinds = "block long, keys binary, sizes binary, ints binary, order binary"
    data = materialize(spark, live(prints).mapInArrow(_blocks(ROWS, True), kinds), "blocks")
    shards = max(n_parts(spark), data.select("block").count() // SHARD)
    data = data.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    asked = live(queries).repartition(max(1, queries.where("n_ints > 0").count() // QUERIES), "rec_id").mapInArrow(_blocks(QUERIES, False), kinds)
    asked = asked.select(F.col("keys").alias("q_keys"), F.col("sizes").alias("q_sizes"), F.col("ints").alias("q_ints"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    kind = "rec_id long, n long, best struct<less: double, id: long, offset: long, error: double, overlap: long>"
    found = asked.hint("merge").join(data, "shard").mapInArrow(_search(own), kind).groupBy("rec_id").agg(F.sum("n").alias("n_matches"), F.min("best").alias("best"))
    return found.select("rec_id", "n_matches", *[F.col(f"best.{c}").alias(f"best_{c}") for c in ("id", "offset", "error", "overlap")])


def scan(spark: SparkSession, table: DataFrame, asked: F.Column, key: str = "rec_id", columns: tuple[str, ...] = ("pcm", "rate"), decode: Decode = pcm16, excerpt: Decode | None = None) -> DataFrame:
    """One row per row of ``table``: rec_id, n_ints, sha256, asked, and for the rows asked for what ``identify`` finds (n_matches 0
    and nulls where nothing aligns). With ``excerpt``, another decoder, what is asked is how its versions of the rows align
    with all recordings, their own included. Rows that share an id share its result. An empty table gives an empty
    result."""
    prints = materialize(spark, fingerprints(table, key, columns, decode), "prints")
    marked = prints.withColumn("asked", asked)
    queries = marked.where("asked")
    if excerpt is not None:
        queries = materialize(spark, fingerprints(table, key, columns, excerpt).withColumn("asked", asked).where("asked"), "excerpts")
    found = identify(spark, prints, queries, own=excerpt is not None)
    out = marked.select("rec_id", "n_ints", "sha256", "asked").join(found, "rec_id", "left")
    return out.withColumn("n_matches", F.when(F.col("asked"), F.coalesce("n_matches", F.lit(0))))
