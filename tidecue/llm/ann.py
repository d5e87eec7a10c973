"""Approximate nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what to rerank."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import materialize, n_parts
from ._tok import binary, ids

#: Code bits for each dimension (rounded up to 64; vectors beyond MOST_BITS dimensions get a bit for each), bound in
#: standard errors, bits that a query's components are rounded to.
SPREAD, MOST_BITS, EPSILON, PLANES = 4, 4096, 3.0, 6
#: Rows and bytes of a data block, rows of a query block, data blocks of a shard (it is held while queries pass by).
ROWS, BLOCK_BYTES, QUERIES, SHARD = 16384, 8 << 20, 512, 4
_SEED = 77


def code_bits(dim: int) -> int:
    return -(-max(dim, min(dim * SPREAD, MOST_BITS)) // 64) * 64


@lru_cache(4)
def rotation(dim: int, bits: int) -> np.ndarray:
    """``bits`` x ``dim`` with orthonormal columns, uniformly random."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors, their norms, and the inner product of each unit vector with its code."""
    norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
    turned = (vectors / norms[:, None]).astype(np.float32) @ turn.T
    return np.packbits(turned > 0, axis=1), norms, np.abs(turned).sum(axis=1, dtype=np.float64) / math.sqrt(turn.shape[0])


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two each, so that the largest component lies in [0.5, 1), and the exponents. That is
    exact, and squares of any finite vector stay finite and above zero."""
    exponents = np.frexp(np.abs(vectors).max(axis=1, initial=0))[1].astype(np.int64)
    return np.ldexp(vectors, -exponents[:, None]), exponents


@dataclass
class Block:
    """Coded rows in order of their keys. ``planes`` is transposed: a row of words for each 64 bits of the code."""

    keys: np.ndarray
    planes: np.ndarray
    norms: np.ndarray
    fit: np.ndarray
    exponents: np.ndarray
    vectors: np.ndarray

    FIELDS = ("keys", "planes", "norms", "fit", "exponents", "vectors")

    @staticmethod
    def of(keys: np.ndarray, vectors: np.ndarray) -> Block:
        order = np.argsort(keys, kind="stable")
        keys, vectors = keys[order], vectors[order]
        x, exponents = scaled(vectors)
        codes, norms, fit = encode(x, rotation(x.shape[1], code_bits(x.shape[1])))
        return Block(keys, np.ascontiguousarray(codes.view(np.uint64).T), norms, fit, exponents, vectors)

    @staticmethod
    def read(batch: pa.RecordBatch, i: int, dim: int) -> Block:
        kinds = dict(zip(Block.FIELDS, (np.int64, np.uint64, np.float64, np.float64, np.int64, np.float64), strict=True))
        got = {f: np.frombuffer(ids(batch, f)[i].as_buffer(), kind) for f, kind in kinds.items()}
        n = len(got["keys"])
        return Block(**got | {"planes": got["planes"].reshape(-1, n), "vectors": got["vectors"].reshape(n, dim)})

    def estimates(self, q: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds on the products with a scaled query, from the packed bits alone: the rotated query is
        rounded to PLANES bits, so its sum over the ones of a code is a sum of bit counts. The estimate is without
        bias; its error is below EPSILON standard errors but with negligible probability."""
        dim = len(q)
        turn = rotation(dim, code_bits(dim))
        t = turn @ q.astype(np.float32)
        bits, low = len(t), float(t.min())
        step = max((float(t.max()) - low) / ((1 << PLANES) - 1), 1e-30)
        rounded = np.rint((t - low) / step).astype(np.int64)
        ones, weighted = np.zeros(len(self.keys), np.int32), np.zeros(len(self.keys), np.int32)
        planes = [np.packbits(rounded >> j & 1 == 1).view(np.uint64) for j in range(PLANES)]
        for w, word in enumerate(self.planes):
            ones += np.bitwise_count(word)
            for j, plane in enumerate(planes):
                weighted += np.bitwise_count(word & plane[w]).astype(np.int32) << j
        on_ones = low * ones + step * weighted
        scale = self.norms / (self.fit * math.sqrt(bits))
        guess = (2 * on_ones - (bits * low + step * int(rounded.sum()))) * scale
        spread = float(np.linalg.norm(q)) * np.sqrt(np.maximum(0, 1 - self.fit**2)) * math.sqrt(bits / (bits - 1)) + step * math.sqrt(bits / 12)
        err = EPSILON * spread * scale + 1e-5 * self.norms * float(np.linalg.norm(q))
        with np.errstate(over="ignore"):
            return np.ldexp(guess - err, self.exponents + exponent), np.ldexp(guess + err, self.exponents + exponent)

    def products(self, at: np.ndarray, q: np.ndarray, exponent: int) -> np.ndarray:
        """Inner products in double precision, added in the order of the components. Beyond double's range they are
        infinite."""
        x, out = np.ldexp(self.vectors[at], -self.exponents[at, None]), np.zeros(len(at))
        for j in range(len(q)):
            out += x[:, j] * q[j]
        with np.errstate(over="ignore"):
            return np.ldexp(out, self.exponents[at] + exponent)


Best = tuple[np.ndarray, np.ndarray]
_NONE: Best = np.zeros(0, np.int64), np.zeros(0)


def _top(keys: np.ndarray, scores: np.ndarray, k: int) -> Best:
    """The k best of different keys; ties go to the smaller one."""
    order = np.lexsort([keys, -scores])
    if len(order) > 1:
        _, first = np.unique(keys[order], return_index=True)
        order = order[np.sort(first)]
    return keys[order[:k]], scores[order[:k]]


def search_block(block: Block, q_keys: np.ndarray, queries: np.ndarray, k: int, before: list[Best] | None = None) -> tuple[list[Best], int]:
    """Each query's best k of the block and of ``before``, what was found in other blocks; and how many vectors were
    reranked. A vector is reranked unless its upper bound is under the k-th best lower bound (of different keys), or
    under the k-th best score before."""
    before = before or [_NONE] * len(q_keys)
    first = np.flatnonzero(np.append(True, block.keys[1:] != block.keys[:-1]))
    out, seen = [], 0
    turned, exponents = scaled(queries)
    for key, q, (b_keys, b_scores), exponent in zip(q_keys, turned, before, exponents.tolist(), strict=True):
        low, high = block.estimates(q, exponent)
        other = block.keys != key
        low[~other] = -np.inf
        best = low if len(first) == len(low) else np.maximum.reduceat(low, first)
        bar = np.partition(best, len(best) - k)[len(best) - k] if len(best) > k else -np.inf
        if len(b_scores) == k:
            bar = max(bar, b_scores[-1])
        at = np.flatnonzero((high >= bar) & other)
        seen += len(at)
        out.append(_top(np.concatenate([b_keys, block.keys[at]]), np.concatenate([b_scores, block.products(at, q, exponent)]), k))
    return out, seen


def _data_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[int, int] = {}

    def block(dim: int) -> pa.RecordBatch:
        parts = held.pop(dim)
        b = Block.of(*(np.concatenate([p[j] for p in parts]) for j in (0, 1)))
        del size[dim]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(b.keys[0])]), *[binary([np.ascontiguousarray(getattr(b, f)).tobytes()]) for f in Block.FIELDS]], ["dim", "block", *Block.FIELDS])

    for dim, keys, vectors in _by_length(batches):
        most = max(1, min(ROWS, BLOCK_BYTES // (8 * dim)))
        for lo in range(0, len(keys), most):
            part = keys[lo : lo + most], vectors[lo : lo + most]
            if size.get(dim, 0) + len(part[0]) > most:
                yield block(dim)
            held.setdefault(dim, []).append(part)
            size[dim] = size.get(dim, 0) + len(part[0])
    for dim in list(held):
        yield block(dim)


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, keys, vectors in _by_length(batches):
        for lo in range(0, len(keys), QUERIES):
            part = keys[lo : lo + QUERIES], vectors[lo : lo + QUERIES]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[binary([x.tobytes()]) for x in part]], ["dim", "q_keys", "q_vectors"])


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each batch by length of the vector: length, keys, vectors."""
    for batch in batches:
        if batch.num_rows:
            lists, keys = ids(batch, "vector"), np.asarray(ids(batch, "vec_id"))
            length, values = np.asarray(lists.value_lengths()), np.asarray(lists.flatten(), dtype=np.float64)
            start = np.cumsum(length) - length
            for dim in np.unique(length).tolist():
                rows = np.flatnonzero(length == dim)
                yield dim, keys[rows], values[start[rows][:, None] + np.arange(dim)]


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, list[int], list[Best]] | None = None

        def found() -> pa.RecordBatch:
            _, who, best = held
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(who, np.int64), [len(b[0]) for b in best])), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                dim, mark = ids(batch, "dim")[i].as_py(), ids(batch, "shard")[i].as_py()
                raw = ids(batch, "q_keys")[i].as_buffer()
                q_keys, q = np.frombuffer(raw, np.int64), np.frombuffer(ids(batch, "q_vectors")[i].as_buffer(), np.float64).reshape(-1, dim)
                mine = b"%d %d " % (dim, mark) + raw.to_pybytes()
                # the blocks of a shard follow each other for a block of queries; another order would only make more rows
                if held and held[0] != mine:
                    yield found()
                    held = None
                best, _ = search_block(Block.read(batch, i, dim), q_keys, q, k, held[2] if held else None)
                held = mine, q_keys.tolist(), best
        if held:
            yield found()

    return run


def nearest(spark: SparkSession, table: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """Each query's ``k`` rows of ``table`` with the largest inner product: query_id, rank, vec_id, score.

    Both tables have a long key and an array of numbers; other columns are not read. A query's own key is no
    candidate. Scores are in double precision on the original vectors, added in the order of the components (infinite
    beyond double's range); ties go to the smaller key. Keys that are null and vectors that are null, empty, zero, or hold
    null or non-finite components take no part; all other vectors do, however large or small. Vectors of different
    lengths have no inner product: candidates are those of the query's length. Of rows that share a key, the best
    counts; queries that share a key give the best of their results. Very long vectors make small blocks. Empty tables
    give an empty result.

    Method: the vectors are scaled by powers of two, rotated at random into SPREAD times as many dimensions and kept as
    sign bits with correction scalars. A block of queries meets every block of codes once, through an equi-join on a
    shard number; estimates from the packed bits, with error bounds, choose the vectors whose exact product is taken.
    What a query found in a block bounds the next one, and a query gives k rows for each shard.
    """
    typed = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    data, asked = (typed(x).where(F.col("vec_id").isNotNull() & finite) for x in (table, queries))
    kinds = ", ".join(f"{c} binary" for c in Block.FIELDS)
    codes = materialize(spark, data.mapInArrow(_data_blocks, f"dim int, block long, {kinds}"), "codes")
    shards = max(n_parts(spark), codes.select("block").count() // SHARD)
    codes = codes.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    few = max(1, asked.count() // QUERIES)
    asked = asked.repartition(few, "vec_id").mapInArrow(_query_blocks, "dim int, q_keys binary, q_vectors binary")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = asked.hint("merge").join(codes, ["dim", "shard"]).mapInArrow(_search(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
