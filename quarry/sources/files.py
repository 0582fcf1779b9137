"""Scans of text, JSON, archives and folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: the first word of each line that has one, in as many rows as there are lines."""
    line = _stripped(F.col("value"))
    return spark.read.text(path).where(line != "").select(F.split(line, r"\s+")[0].alias("id"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id: the distinct lines, without white space around them; blank lines are none."""
    return spark.read.text(path).select(_stripped(F.col("value")).alias("id")).where("id <> ''").distinct()


def _file(pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("path"), pattern, 1), F.lit(""))


def chart_ids(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """id: the first group of the pattern in the path of each file below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(_file(pattern).alias("id")).where("id is not null").distinct()


def with_both(charts: DataFrame, images: DataFrame) -> DataFrame:
    """The ids that both listings have."""
    return charts.join(images, "id", "left_semi")


def whole_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """id and text of every file below a folder, one row a file; the id is the first group of the pattern in the path."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return found.select(F.col("_metadata.file_path").alias("path"), "value").select(_file(pattern).alias("id"), F.col("value").alias("text"))


def zip_members(files: DataFrame, suffix: str = "", encoding: str = "utf-8") -> DataFrame:
    """path, member, text of each file in archives (path and content, as the binary file source gives them).

    An archive is one task's; its members are read one at a time. What is no archive has no members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                for name in archive.namelist():
                    if name.endswith(suffix) and not name.endswith("/"):
                        yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([name], pa.string()), pa.array([archive.read(name).decode(encoding, "replace")], pa.string())], ["path", "member", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, text string")


def json_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The records of JSON that is an array in each file, or else one object a line; the first character decides."""
    head = spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.substring(_stripped(F.col("value")), 1, 1).alias("c")).limit(1).collect()
    reader = spark.read.option("multiLine", bool(head) and head[0].c == "[")
    return (reader if schema is None else reader.schema(schema)).json(path)


def json_files(spark: SparkSession, path: str, schema: StructType | str | None = None, recursive: bool = True) -> DataFrame:
    """One record for each JSON file below a folder, with the file's path in `file`."""
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", recursive)
    return (reader if schema is None else reader.schema(schema)).json(path).select("*", F.col("_metadata.file_path").alias("file"))


def saved(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A data set that was written by `sinks.save`, or one split of it (a partition: others are not read)."""
    found = spark.read.parquet(path)
    return found if split is None else found.where(F.col("split") == split).drop("split")
