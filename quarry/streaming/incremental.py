"""Runs that take only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def run_available(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df, form: str = "parquet", mode: str = "append") -> None:
    """Read the files of a folder that no earlier run has read, pass them through a step, and append the result.

    What was read is known from the checkpoint, so a run after a failure goes on where the last one stopped, and its
    output is written exactly once.
    """
    stream = step(spark.readStream.schema(schema).format(form).load(source))
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()
