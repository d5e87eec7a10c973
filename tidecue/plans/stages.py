"""Content-addressed stages: a table is built once for what identifies its inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import fingerprint

#: Part of every stage's identity; rises when an operator's results change.
REVISION = 1
#: The file that names a stage's finished table.
MANIFEST = "CURRENT"


def identity(parts: dict[str, object]) -> str:
    plain = {k: asdict(v) if is_dataclass(v) and not isinstance(v, type) else v for k, v in parts.items()}
    return fingerprint(plain | {"revision": REVISION})


def _file(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path and its file system, of any kind that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> str | None:
    """The finished table of a stage, which its manifest names; None if there is none."""
    at, there = _file(spark, f"{path}/{MANIFEST}")
    return f"{path}/{spark.read.text(at.toString()).first()[0]}" if there.exists(at) else None


def publish(spark: SparkSession, path: str, table: DataFrame, replace: bool = False) -> str:
    """Write ``table`` under a name of its own, then make the manifest of ``path`` name it, in one step: readers see the table of
    before or this one, never half of one. Without ``replace`` the first of several writers is the one that counts; the others
    drop theirs. Returns the path that counts."""
    name = uuid.uuid4().hex
    table.write.parquet(f"{path}/{name}")
    at, there = _file(spark, f"{path}/{MANIFEST}")
    note, _ = _file(spark, f"{path}/.{name}")
    out = there.create(note, True)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    how = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if replace else how.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(note, at, options)
    except Py4JJavaError as taken:
        if "FileAlreadyExists" not in str(taken.java_exception):
            raise
        there.delete(note, False)
        there.delete(_file(spark, f"{path}/{name}")[0], True)
    return published(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that spark.checkpoint.dir names: the plan behind it ends there, and its rows
    outlive lost executors. Where none is set, a local master gets a temporary one; on a cluster that is an error, since its
    machines would not see each other's files."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table by columns: a fraction of a checkpoint's bytes where rows hold words."""
    spark = df.sparkSession
    path = f"{_checkpoints(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _checkpoints(spark: SparkSession) -> str:
    if not spark.sparkContext.getCheckpointDir():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidecue-"))
    return spark.sparkContext.getCheckpointDir()


def build_once(spark: SparkSession, root: str, parts: dict[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table under ``root``; ``build`` runs only if nothing was finished for this identity before. A build that fails
    leaves nothing that counts, and of builds at the same time all get the table of the first."""
    path = f"{root.rstrip('/')}/{identity(parts)}"
    return spark.read.parquet(published(spark, path) or publish(spark, path, build()))


def script_once(spark: SparkSession, root: str, parts: dict[str, object], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The script's table, and whether a person has edited it: what was edited goes before what was built, and is never
    built over."""
    edited = published(spark, edited_path(root, parts))
    if edited:
        return spark.read.parquet(edited), True
    return build_once(spark, root, parts, build), False


def edited_path(root: str, parts: dict[str, object]) -> str:
    return f"{root.rstrip('/')}/{identity(parts)}-edited"


def save_edited(script: DataFrame, root: str, parts: dict[str, object]) -> None:
    """Keep an edited script for later runs over the same inputs; it may come from the table that it replaces."""
    publish(script.sparkSession, edited_path(root, parts), script, replace=True)


def stage_copy(spark: SparkSession, path: str, folder: str) -> str:
    """A copy of a finished file under its own name in a new private folder, to be handed out while the original may go on
    changing. Both may be in any file system that Spark knows."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    source = hadoop.Path(path)
    home = hadoop.Path(f"{folder.rstrip('/')}/{uuid.uuid4().hex}")
    there = home.getFileSystem(conf)
    there.mkdirs(home)
    there.setPermission(home, hadoop.permission.FsPermission("700"))
    copy = hadoop.Path(home, source.getName())
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, there, copy, False, conf)
    return copy.toString()
