"""Writers of charts, records, reports and histories; each is one Spark job under the commit protocol."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.records import last_wins, output_name


_own: list[str] = []


@atexit.register
def _clean() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: spark.checkpoint.dir, else the context's own.

    Where neither is set, a folder of ours if executors are threads of the driver, as in tests, else the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quarry-"))
        base = _own[0]
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"


def write_charts(df: DataFrame, path: str, by: Sequence[str] = ("dataset",)) -> None:
    """Charts as Parquet, a partition a data set; all of it appears at once or not at all."""
    df.write.partitionBy(*by).mode("overwrite").parquet(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder for each key with the text in it, and a line feed after the text."""
    df.select(key, F.col(text).alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def write_records(df: DataFrame, path: str, dataset: str = "dataset") -> None:
    """Records as JSON lines, a folder for each data set under its output name."""
    df.withColumn(dataset, output_name(F.col(dataset))).write.partitionBy(dataset).mode("overwrite").json(path)


def write_by_key(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """One record for each key, the last in order; a folder a key."""
    last_wins(df, keys, order).write.partitionBy(*keys).mode("overwrite").json(path)


def write_array(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """All records as one JSON array in one file, for readers that take nothing else; it has to fit in one row."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("r")))).alias("rows"))
    rows.select(F.to_json(F.transform("rows", lambda x: x["r"])).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header; texts with line breaks or quotes are quoted, and null is not the empty text."""
    df.write.option("header", "true").option("escape", '"').option("emptyValue", '""').option("nullValue", "").mode("overwrite").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON object for each row."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def metric_rows(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """key, metric, value: a row for each metric of each row; null values stay."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(key, F.explode(pairs).alias("m")).select(key, "m.metric", "m.value")


def write_ids(df: DataFrame, path: str, key: str, where: Column | None = None) -> None:
    """The ids, one a line."""
    kept = df if where is None else df.where(where)
    kept.select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_history(df: DataFrame, path: str, at: Column | None = None) -> None:
    """One more entry for each row, with its time; runs side by side append without reading what is there."""
    df.withColumn("timestamp", F.current_timestamp() if at is None else at).write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key and entries: all that was appended for a key, in order of time."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (key, "timestamp")]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("timestamp", *rest))).alias("entries"))


def save(df: DataFrame, path: str, split: str = "split") -> None:
    """A data set with a partition for each split, and nothing of it kept in memory afterwards."""
    df.write.partitionBy(split).mode("overwrite").parquet(path)
    df.unpersist()
