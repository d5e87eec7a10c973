"""An extension: episodes that arrive as files run through the batch stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def watch(spark: SparkSession, folder: str, schema: StructType, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Runs ``stage`` over the new Parquet files of a folder and appends its rows under ``out``; a batch that is repeated
    after a failure overwrites its own rows. An episode is complete when its file is there, so no watermark is needed."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
