"""Lookups along a line of time or of numbers, in cells: no key, however long its line, is sorted in one task.

A key's rows are dealt by (key, cell). What a cell needs of those before it is one row, found from one row for each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import cut

#: Width of a cell in seconds, and in numbers of lines.
SECONDS, NUMBERS = 600.0, 4096.0


def _carried(cells: DataFrame, value: str, forward: bool) -> DataFrame:
    """Of (key, cell, value): the value of the nearest cell before (after, with ``forward``) that has one."""
    way = W.partitionBy("key").orderBy(F.desc("cell") if forward else F.asc("cell")).rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("carried", F.last(value, ignorenulls=True).over(way)).where("carried is not null").select("key", "cell", F.col("carried").alias(value))


def asof(rows: DataFrame, marks: DataFrame, at: Column, name: str, *, key: str = "episode_id", mark: str = "t", tie: tuple[str, ...] = (), value: Column | None = None, forward: bool = False, strict: bool = False, cell: float = SECONDS) -> DataFrame:
    """``rows`` with ``name``: ``value`` (a struct of all columns of ``marks`` by default) of the last of ``marks`` (key, mark) that is not
    after the row's time ``at``, or with ``forward`` the first that is not before it; ``strict``: neither at it. Among marks at
    the same place the columns ``tie`` order. Null if there is none. Marks without a place and rows without a time find nothing.

    ``rows`` are cut first: they are read twice, and lookups follow each other."""
    rows = cut(rows)
    value = F.struct(*marks.columns) if value is None else value
    place, order = F.col(mark).cast("double"), F.struct(*(tie or (mark,)))
    of = lambda t: F.floor(t / cell)
    m = marks.where(F.col(mark).isNotNull()).select(F.col(key).alias("key"), of(place).alias("cell"), place.alias("t"), order.alias("k"), value.alias("v"))
    asked = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("key"), of(at.cast("double")).alias("cell"), at.cast("double").alias("t"))
    nearest = (F.min_by if forward else F.max_by)("v", F.struct("t", "k"))
    cells = m.groupBy("key", "cell").agg(nearest.alias("v")).unionByName(asked.select("key", "cell").distinct(), allowMissingColumns=True)
    cells = _carried(cells.groupBy("key", "cell").agg(F.first("v", ignorenulls=True).alias("v")), "v", forward)
    # in the order of search: what is carried, then marks and rows; at the same place marks come first, unless they don't count
    side = F.lit(2 if strict else 0)
    first = F.lit(float("inf") if forward else float("-inf"))
    x = asked.withColumn("side", F.lit(1)).unionByName(m.withColumn("side", side), allowMissingColumns=True)
    x = x.unionByName(cells.select("key", "cell", first.alias("t"), "v", F.lit(0).alias("side")), allowMissingColumns=True)
    way = W.partitionBy("key", "cell").orderBy(*([F.desc("t"), "side", F.desc("k")] if forward else [F.asc("t"), "side", F.asc("k")])).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn(name, F.last("v", ignorenulls=True).over(way)).where("row is not null")
    # a row without a time is in no cell
    return x.select("row.*", F.when(F.col("t").isNotNull(), F.col(name)).alias(name))


def running_most(rows: DataFrame, by: list[str], value: str, name: str, *, key: str = "episode_id", cell: float = SECONDS) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` up to the row in the order of ``by``, the first of which is a number."""
    x = rows.withColumn("__cell", F.floor(F.col(by[0]) / cell))
    tops = x.groupBy(F.col(key).alias("key"), F.col("__cell").alias("cell")).agg(F.max(value).alias("v"))
    before = W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(F.col("key").alias(key), F.col("cell").alias("__cell"), F.max("v").over(before).alias("__top"))
    own = F.max(value).over(W.partitionBy(key, "__cell").orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    return x.join(tops, [key, "__cell"]).withColumn(name, F.greatest(own, "__top")).drop("__cell", "__top")


def numbered(rows: DataFrame, group: list[str], by: list[Column | str], place: Column, name: str, *, cell: float = NUMBERS) -> DataFrame:
    """``rows`` with ``name``, its number from 0 on in its group in the order of ``by``, and ``name`` with _of, the group's size. ``place``
    is a number that does not fall along the order (null: after all others); cells of it are counted, then numbered."""
    x = rows.withColumn("__cell", F.coalesce(F.floor(place / cell), F.lit(1 << 62)))
    sizes = x.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    all_cells = W.partitionBy(*group)
    before = all_cells.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*group, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(all_cells).alias(f"{name}_of"))
    # groups may be null
    met = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "__cell"]]
    for more in met[1:]:
        met[0] = met[0] & more
    x = x.alias("a").join(sizes.alias("b"), met[0]).select("a.*", "b.__first", f"b.{name}_of")
    return x.withColumn(name, F.row_number().over(W.partitionBy(*group, "__cell").orderBy(*by)) - 1 + F.col("__first")).drop("__cell", "__first")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], *, cell: float) -> DataFrame:
    """(keys, n, and for each name its share's quantile) of the values that are not null, between the two nearest ones as they are
    apart. Values are numbered by cells of their size, so a key's values are never held or sorted together."""
    x = numbered(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")), keys, ["__v"], F.col("__v"), "__at", cell=cell)
    last = F.col("__at_of") - 1
    out = [F.max("__at_of").alias("n")]
    near = F.lit(False)
    for name, share in shares.items():
        place = last * share
        low, part = F.floor(place), place - F.floor(place)
        near = near | (F.col("__at") == low) | (F.col("__at") == low + 1)
        a = F.max(F.when(F.col("__at") == low, F.col("__v")))
        b = F.max(F.when(F.col("__at") == low + 1, F.col("__v")))
        out.append(F.when(F.max(part) > 0, a + (b - a) * F.max(part)).otherwise(a).alias(name))
    return x.where(near).groupBy(*keys).agg(*out)
