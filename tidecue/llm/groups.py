"""Links within large groups, without comparing all with all: sorted neighbours first, then what they leave apart.

A group is any set of rows that may be alike (they share a bucket or a prefix). It can hold any share of the rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tok import ids

#: How many rows that follow in the sorted order a row meets.
NEAREST = 2
#: Rows and bytes of cells that are gone through together, and pairs that are looked at at a time.
HELD_ROWS, HELD_BYTES, PAIRS = 1 << 14, 32 << 20, 1 << 20


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


#: Of two rows' carried columns, which pairs may be linked.
May = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def neighbours(rows: DataFrame, may: May | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(a, b) with a < b: of ``rows`` (group, rest, id), each with the NEAREST that follow in its group, in the order of
    ``rest``. Range partitions hold no more of a group than of anything else; pairs across their borders are left out, and so are
    those that ``may`` rules out by the numbers in the columns ``carried``."""
    order = ["group", "rest", "id"]
    return rows.select(*order, *carried).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_followers(may, carried), "a long, b long").where("a < b")


def _followers(may: May | None, carried: tuple[str, ...]) -> Callable:
    """Of sorted rows (group, id), each with the NEAREST that follow in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "id", *carried]
        held = [np.zeros(0, np.int64) for _ in names]
        for batch in batches:
            old = len(held[0])
            group, key, *more = held = [np.concatenate([x, np.asarray(ids(batch, n))]) for x, n in zip(held, names, strict=True)]
            a, b = [], []
            for step in range(1, NEAREST + 1):
                to = np.arange(max(old, step), len(key))
                to = to[group[to] == group[to - step]]
                if may:
                    to = to[may([x[to] for x in more], [x[to - step] for x in more])]
                a.append(np.minimum(key[to], key[to - step]))
                b.append(np.maximum(key[to], key[to - step]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            held = [x[-NEAREST:] for x in held]

    return run


def cells(rows: DataFrame, known: DataFrame, block: int, block_mass: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(group, x, y, id, known, side, and the columns ``carried``) of the blocks in which the members of groups (group, id, mass) still have to meet. In a
    block, side 0 meets side 1; where all are of side 2, all meet.

    ``known`` (node, component) has what was found so far. A group within one component is done. In the others, the largest
    component's members need not meet each other: only the rest meet them, and each other. So the blocks are as many
    as the largest component has, times those of the rest, and a member of the largest one is copied once for each block of
    the rest."""
    members = rows.join(known.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("known", F.coalesce("component", "id")).drop("component")
    parts = members.groupBy("group", "known").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"))
    whole = parts.groupBy("group").agg(F.max(F.struct("n", F.negative("known").alias("less"), "mass")).alias("top"), F.sum("n").alias("size"), F.sum("mass").alias("mass")).where("top.n < size")
    blocks = lambda n, mass: F.ceil(F.greatest(n / block, mass / block_mass)).cast("int")
    whole = whole.select("group", F.negative("top.less").alias("main"), blocks(F.col("top.n"), F.col("top.mass")).alias("mains"), blocks(F.col("size") - F.col("top.n"), F.col("mass") - F.col("top.mass")).alias("rests"), (F.col("size") - F.col("top.n") == 1).alias("alone"))
    met = members.join(whole, "group").withColumn("is_main", F.col("known") == F.col("main"))
    met = met.withColumn("me", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    of_main = F.transform(upto("rests"), lambda x: cell(x, F.col("me"), F.lit(1)))
    to_main = F.transform(upto("mains"), lambda y: cell(F.col("me"), y, F.lit(0)))
    to_rest = F.transform(upto("rests"), lambda o: cell(F.least("me", o), F.col("mains") + F.greatest(F.col("me"), o), F.when(F.col("me") == o, 2).when(F.col("me") < o, 0).otherwise(1)))
    # mostly there is one block of each, and the rest is often a single row, which meets nothing but the largest component
    zero, one = F.lit(0), F.lit(1)
    few = F.when(F.col("is_main"), F.array(cell(zero, zero, one))).when(F.col("alone"), F.array(cell(zero, zero, zero))).otherwise(F.array(cell(zero, zero, zero), cell(zero, one, F.lit(2))))
    many = F.when(F.col("is_main"), of_main).otherwise(F.concat(to_main, to_rest))
    met = met.select("group", "id", "known", *carried, F.explode(F.when((F.col("mains") == 1) & (F.col("rests") == 1), few).otherwise(many)).alias("cell"))
    return met.select("group", "cell.x", "cell.y", "id", "known", "cell.side", *carried)


#: Columns of ``members_mark``.
SAME = ["same_a", "same_b", "same_c", "same_d"]


def members_mark(member: str) -> list[Column]:
    """Aggregates that are equal for groups of the same members, each as often: sums of their hashes, of the upper and
    lower 32 bits, which a long holds for 2**31 members."""
    sums = lambda h: (F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))))
    return [c.alias(n) for c, n in zip((*sums(F.xxhash64(member)), *sums(F.xxhash64(member, F.lit(1)))), SAME, strict=True)]


def different(sized: DataFrame) -> DataFrame:
    """Of groups (size, ``members_mark``) with the same members, one."""
    return sized.dropDuplicates(["size", *SAME]).drop(*SAME)


def by_cell(rows: DataFrame, links: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) that ``links`` gives for the rows of each cell (group, x, y). Cells follow each other in sorted partitions, so
    many small ones cost no more than their rows, and only one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple[int, ...] | None = None
        for batch in batches:
            at = [np.asarray(ids(batch, c)) for c in ("group", "x", "y")]
            new = np.flatnonzero(np.any([np.diff(v) != 0 for v in at], axis=0)) + 1
            found: list[tuple[int, int]] = []
            for lo, hi in itertools.pairwise([0, *new.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                cell = tuple(int(v[lo]) for v in at)
                if held and cell != last:
                    found += links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = cell
            yield _pairs(found)
        if held:
            yield _pairs(links(pa.Table.from_batches(held)))

    return rows.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(run, "a long, b long")


def in_cells(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``work`` gives for many whole cells (group, x, y) at a time: it gets their rows by cell and side, and the rows'
    cells, numbered from 0 on. No more is held than HELD rows or bytes and one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            order = np.lexsort([np.asarray(table.column(c)) for c in ("side", "y", "x", "group")])
            table = table.take(pa.array(order)).combine_chunks()
            at = [np.asarray(table.column(c)) for c in ("group", "x", "y")]
            return work(table, np.append(0, np.cumsum(np.any([np.diff(v) != 0 for v in at], axis=0))))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS or sum(b.nbytes for b in held) >= HELD_BYTES:
                table = pa.Table.from_batches(held)
                at = [np.asarray(table.column(c)) for c in ("group", "x", "y")]
                border = np.flatnonzero(np.any([np.diff(v) != 0 for v in at], axis=0))
                # the last cell may go on
                if len(border):
                    cut = int(border[-1]) + 1
                    yield done(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return rows.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(run, schema)


def meetings(cell: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows in order of (cell, side) that meet: those of side 0 all of side 1 in their cell, those of side 2 each
    other. PAIRS at a time, or what one row meets."""
    n = len(cell)
    kind, end = cell * 4 + side, np.searchsorted(cell, cell, side="right")
    first = np.where(side == 0, np.searchsorted(kind, cell * 4 + 1), np.where(side == 2, np.arange(1, n + 1), end))
    count = end - first
    upto = np.append(0, np.cumsum(count))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, side="right")) - 1)
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        yield i, np.arange(len(i)) + np.repeat(first[lo:hi] - (np.cumsum(c) - c), c)
        lo = hi


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], pa.int64()) for j in (0, 1)], ["a", "b"])
