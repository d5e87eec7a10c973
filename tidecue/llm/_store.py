"""Shared storage for intermediate tables: the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local master gets a temporary one (tests, notebooks); on a
    cluster that is an error, since executors and driver would not see each other's files."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        named = "file://" + tempfile.mkdtemp(prefix="tidecue-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidecue/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def ending_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends: the table that it writes replaces them."""
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialize(spark: SparkSession, df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut and the rows
    survive lost executors. The table stays until ``forget`` or ``clean``."""
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    with ending_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tidecue_path = path
    return table


#: Bits of the filter that ``maybe_in`` sends to the tasks: 4 MB, whatever the table holds.
FILTER_BITS = 1 << 25


def bit_filter(spark: SparkSession, keys: DataFrame, key: str, hashed: bool = False) -> Broadcast:
    """A bitmap of the hashes of ``key`` (a long; with ``hashed`` a hash already) modulo FILTER_BITS. Its size is fixed; the more keys there are, the less it
    sifts, so what passes has to be joined with ``keys`` still. It is put together on the executors."""
    bit = F.pmod(F.col(key) if hashed else F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    parts = keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("position")).groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    with ending_shuffles(spark):
        rows = parts.collect()  # FILTER_BITS / 32,768 rows of 4 kB at most
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def maybe_in(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes (xxhash64 of keys, as Spark computes them) are in a filter."""
    at = hashed % FILTER_BITS
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        _delete(spark, t._tidecue_path)


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application. Results that were not read yet can't be read any more, so it is called
    when they have been written."""
    _delete(spark, _home(spark))


def free_name(table: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it a name that no column of ``table`` has."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
