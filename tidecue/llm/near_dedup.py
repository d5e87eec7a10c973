"""MinHash near-duplicate detection with an LSH forest, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bit_filter, forget, free_name, materialize, maybe_in
from ._tok import binary, chunks, ids, mix, runs
from .components import connected_components
from .groups import Forest, by_cell, cells, different, members_mark, neighbours

TREES, DEPTH = 21, 3
#: A region (equal first DEPTH values in one order) up to this size gives its pairs at once. In a larger one documents
#: are sorted by the next DEEPER values and meet those that follow. What is then not connected is compared in blocks,
#: sized by what a task holds: documents and shingles of a block.
REGION, DEEPER, BLOCK, BLOCK_SHINGLES = 12, 8, 1024, 1 << 18
_SEED = 20240229


def _perms(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return (rng.integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _sets(batch: pa.RecordBatch, k: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a batch."""
    for c in chunks(batch, lower=lower):
        h = c.hashes()
        s = runs(h, k)
        for i in range(c.hi - c.lo):
            a, b = c.first[i], c.first[i + 1]
            if b - a >= k:
                yield c.lo + i, np.unique(s[a : b - k + 1])
            elif b > a:
                yield c.lo + i, runs(h[a:b], int(b - a))
            else:
                yield c.lo + i, s[:0]


def _minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(low, (s[None, i : i + 1024] * a[:, None] + b[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _describe(k: int, lower: bool, n_values: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _perms(n_values)
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for _, s in _sets(batch, k, lower):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(_minhash(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(sizes, pa.int64()), binary(digests), binary(sigs)], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def _only_sets(k: int, lower: bool, n_values: int, wanted: Broadcast) -> Callable:
    """Signatures and sets of the rows whose doc_id (with its hash) is in the filter ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _perms(n_values)
        for batch in batches:
            mine = batch.filter(pa.array(maybe_in(wanted.value, np.asarray(ids(batch, "hashed")))))
            for lo in range(0, mine.num_rows, 256):
                part = mine.slice(lo, 256)
                sets = [s for _, s in _sets(part, k, lower)]
                yield pa.RecordBatch.from_arrays([ids(part), binary([_minhash(s, a, b).tobytes() for s in sets]), binary([s.tobytes() for s in sets])], ["doc_id", "sig", "shingles"])

    return run


def _regions(trees: int, depth: int) -> Callable:
    """A row for each document and order: the hash of the first ``depth`` values in the order, and the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(ids(batch, "sig").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            keys = np.zeros((batch.num_rows, trees), np.uint64)
            for t in range(trees):
                key = np.full(batch.num_rows, t, np.uint64)
                for j in range(depth):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, t * depth + j])
                keys[:, t] = key
            doc, n = (np.repeat(np.asarray(ids(batch, x)), trees) for x in ("doc_id", "n_shingles"))
            tree = np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(tree), pa.array(doc), pa.array(n)], ["region", "tree", "doc_id", "n_shingles"])

    return run


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(ids(batch, "sa"), ids(batch, "sb"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([ids(batch, "a").filter(m), ids(batch, "b").filter(m)], ["a", "b"])

    return run


def _links_of_block(sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect what ``known`` (a component number for each row) leaves apart: between the rows of side
    0 and those of side 1, or among all if all are of side 2. Pairs whose signatures agree in less than the threshold by
    six standard errors are left out."""
    n, forest, found = len(sets), Forest(len(sets)), []
    _, start, which = np.unique(known, return_index=True, return_inverse=True)
    for i in range(n):
        forest.join(i, int(start[which[i]]))
    sizes = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    common = counts[inverse] > 1
    number = np.cumsum(counts > 1) - 1
    bits = np.zeros((n, (int((counts > 1).sum()) + 63) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner[common], number[inverse[common]] >> 6), np.uint64(1) << (number[inverse[common]] & 63).astype(np.uint64))
    likely = max(0.0, percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / sigs.shape[1]))
    among = bool((side == 2).all())
    rows, cols = (np.arange(n), np.arange(n)) if among else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for i in rows:
        to = cols[cols > i] if among else cols
        to = to[known[to] != known[i]]
        small, large = np.minimum(sizes[to], sizes[i]), np.maximum(sizes[to], sizes[i])
        to = to[100 * small >= percent * large]
        near = to[(sigs[to] == sigs[i]).mean(axis=1) >= likely]
        mine = forest.root(int(i))
        near = near[np.array([forest.root(int(x)) for x in near], dtype=np.int64) != mine]
        if len(near):
            both = np.bitwise_count(bits[near] & bits[i]).sum(axis=1, dtype=np.int64)
            for x in near[100 * both >= percent * (sizes[near] + sizes[i] - both)]:
                if forest.join(int(i), int(x)):
                    found.append((int(i), int(x)))
    return found


def _blocks(percent: int) -> Callable:
    def run(table: pa.Table) -> list[tuple[int, int]]:
        doc, side, known = (np.asarray(table.column(x)) for x in ("doc_id", "side", "known"))
        if (side == 2).all() or ((side == 0).any() and (side == 1).any()):
            sigs = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("sig")])
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")]
            return [(int(doc[x]), int(doc[y])) for x, y in _links_of_block(sigs, sets, side, known, percent)]
        return []

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; other columns are not read): doc_id, n_shingles,
    component_id, kept.

    Documents whose distinct k-word shingle sets have ``100 * intersection >= percent * union`` are linked;
    component_id is the smallest doc_id reachable and kept says doc_id = component_id. The shingle of a text
    with fewer than k words is its whole word sequence; null, empty and blank texts have n_shingles 0 and are
    linked with nothing. Texts count whole, however long. A null doc_id gives a null component_id and is kept. Rows
    that share a doc_id count as one node, and repeated rows stay. At the threshold itself documents are linked. An empty table
    gives an empty result.

    Method: equal sets collapse to their smallest doc_id. An LSH forest holds ``trees`` orders of the MinHash
    values; documents that agree on the first ``depth`` values of an order form a region, which two documents
    at the threshold share in at least one order with probability 1 - (1 - 0.8**3)**21 > 1 - 3e-7. Small
    regions give their pairs as candidates. Larger ones go deeper: they are sorted by the next values, through range
    partitions that no region can overfill, and the longest-common-prefix neighbours are the candidates. Regions that the
    confirmed candidates leave in several components are closed: what is outside the largest component is
    compared with all in blocks, as far as signatures allow the threshold (but for six standard errors).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    about = materialize(spark, docs.mapInArrow(_describe(k, lower, trees * depth), "doc_id long, n_shingles long, digest binary, sig binary"), "sigs")
    live = about.where("digest is not null and doc_id is not null")
    # a table of its own: a join whose sides are plain exchanges can split the rows of a hot class
    classes = materialize(spark, live.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "classes")
    first = materialize(spark, live.join(classes, "digest").where("doc_id = first_id").select("doc_id", "sig", "n_shingles").distinct(), "first")
    several = live.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("doc_id")
    own = live.join(several, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))

    region = first.mapInArrow(_regions(trees, depth), "region long, tree int, doc_id long, n_shingles long")
    sized = region.groupBy("region").agg(F.count(F.lit(1)).alias("size"), *members_mark("doc_id")).where("size > 1")
    # the same documents often share several regions
    sized = materialize(spark, different(sized), "sized")
    regions = materialize(spark, region.join(sized.hint("shuffle_hash"), "region"), "regions")
    forget(spark, sized)
    small = regions.where(F.col("size") <= REGION).groupBy("region").agg(F.sort_array(F.collect_set("doc_id")).alias("m"))
    pairs = small.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    # the same values in each order, from those after the region's on and around; any order of the bytes will do
    large = regions.where(F.col("size") > REGION)
    deeper = F.expr(f"substring(concat(sig, sig), {4 * depth} * (tree + 1) + 1, {4 * DEEPER})")
    deep = materialize(spark, large.join(first.select("doc_id", "sig"), "doc_id").select(F.col("region").alias("group"), deeper.alias("rest"), F.col("doc_id").alias("id")), "deep")
    pairs = materialize(spark, pairs.union(neighbours(deep)).where("a < b").distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(large.select("doc_id")).distinct()
    # texts stay where they are: a filter of fixed size goes to them, and the sets of what passes are joined
    wanted = materialize(spark, wanted, "wanted")
    texts = docs.where("doc_id is not null").withColumn("hashed", F.xxhash64("doc_id"))
    sets = texts.mapInArrow(_only_sets(k, lower, trees * depth, bit_filter(spark, wanted, "doc_id")), "doc_id long, sig binary, shingles binary")
    sets = materialize(spark, sets.where("length(shingles) > 0").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "sig"]), "sets")
    forget(spark, wanted)

    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    links = materialize(spark, pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirm(percent), "a long, b long").union(own), "linked")
    forget(spark, first, deep, pairs)
    comp = materialize(spark, connected_components(spark, links), "components")
    members = large.select(F.col("region").alias("group"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("mass"))
    apart = materialize(spark, cells(members, comp, BLOCK, BLOCK_SHINGLES).withColumnRenamed("id", "doc_id"), "apart")
    closing = materialize(spark, by_cell(apart.join(sets, "doc_id"), _blocks(percent)), "closing")
    forget(spark, regions, sets, links, apart)
    if not closing.isEmpty():
        comp = connected_components(spark, closing.union(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    of_class = classes.join(comp, F.col("first_id") == F.col("node"), "left").select("digest", F.coalesce("component", "first_id").alias("component_id"))
    return _on_rows(about, of_class)


def _on_rows(about: DataFrame, of_class: DataFrame) -> DataFrame:
    """The classes' components back on every row."""
    none = about.where("digest is null").withColumn("component_id", F.lit(None).cast("long"))  # not all in one task
    joined = about.where("digest is not null").join(of_class, "digest", "left").unionByName(none)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (the smallest doc_id); all its columns stay. Of rows
    that repeat a kept doc_id, all stay: they are rows of one document. Rows are treated as ``near_duplicates`` says."""
    of = free_name(docs, "_of")
    gone = near_duplicates(spark, docs, k, percent).where("not kept").select(F.col("doc_id").alias(of)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(of), "left_anti").select(docs.columns)
