"""Training records: chat structures, deduplication by key, splits, shards, length reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import numeric as N
from quarry.functions import text as T

# Prompts of the record format and the renaming of one dataset.
SYSTEM_PROMPT = "You are a world-class SVG Expert and Data Visualization Engineer. Your primary objective is to interpret rasterized chart images and reconstruct them into high-quality, semantically correct SVG code."
USER_PROMPT = "<image>Convert this image to SVG code."
RENAMED = {"graphiq_clean": "graphiq"}
THRESHOLDS = (6144, 8192, 16384)
IMAGE_COST = 1350
LENGTH_CAP = 80_000


def chat_record(answer: Column, image: Column, system: Column | None = None, user: Column | None = None) -> Column:
    """{messages: [system, user, assistant], images: [path]}."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(say("system", F.lit(SYSTEM_PROMPT) if system is None else system), say("user", F.lit(USER_PROMPT) if user is None else user), say("assistant", answer))
    return F.struct(messages.alias("messages"), F.array(image).alias("images"))


def conversation_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each conversation: its turns as an array in order."""
    turn = F.struct(F.col(order).alias("k"), "role", F.col("text").alias("content"))
    own = F.transform(F.array_sort(F.collect_list(turn)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy(key).agg(own.alias("messages"))


def last_of_role(messages: Column, role: str) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def assistant_response(messages: Column, response: Column, answer: Column) -> Column:
    """The last assistant message, even if empty; without one the response, the answer or nothing."""
    said = F.exists(messages, lambda m: m["role"] == "assistant")
    return F.when(F.coalesce(said, F.lit(False)), F.coalesce(last_of_role(messages, "assistant"), F.lit(""))).otherwise(F.coalesce(T.nonempty(response), T.nonempty(answer), F.lit("")))


def image_path(entry: Column) -> Column:
    """The path in a map of an image entry: the first of the known keys, or else its first value."""
    return F.coalesce(*[F.try_element_at(entry, F.lit(k)) for k in T.IMAGE_KEYS], F.get(F.map_values(entry), F.lit(0)))


def output_name(dataset: Column) -> Column:
    for old, new in RENAMED.items():
        dataset = F.when(dataset == old, new).otherwise(dataset)
    return dataset


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, as when each writes the file of its key in turn.

    A max by key, combined before the shuffle, so a key with very many rows costs no more than others.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def hash_split(key: Column, test_share: float = 0.1) -> Column:
    """train or test by a stable hash of the key: the same on every run, and for a key whatever the other rows."""
    return F.when(T.stable_hash(key) % 1000 < int(test_share * 1000), "test").otherwise("train")


#: Rows that one range of a total order holds, about.
RANGE = 500_000


def _ranges(df: DataFrame, order: Sequence[str], size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """The rows dealt by range of a total order and written with their range's number, and the count of each range.

    Both ranks and offsets are taken from what is written, so they fit whatever a later run of the plan would do.
    """
    from quarry.sinks import scratch

    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // size))
    path = scratch(spark, "ranges")
    df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    return dealt, dealt.groupBy("__p").agg(F.count("*").alias("n"))


def _numbered(dealt: DataFrame, counts: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    before = counts.select("__p", (F.sum("n").over(W.orderBy("__p")) - F.col("n")).alias("before"))  # a row for each range
    inner = dealt.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1)
    return inner.join(before, "__p").withColumn(name, (F.col("before") + F.col("__k")).cast("long")).drop("__p", "__k", "before")


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank", size: int = RANGE) -> DataFrame:
    """Row numbers from 0 over a total order of all rows, without a window over the whole table.

    Rows are dealt by range, more of them for more rows; counts of the ranges, one row each, give the offsets.
    """
    return _numbered(*_ranges(df, order, size), order, name)


def contiguous_shards(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Runs of the order of nearly equal size, the larger first, as ntile gives."""
    dealt, counts = _ranges(df, order)
    total = counts.agg(F.sum("n")).first()[0] or 0
    q, r = divmod(total, shards)
    rank = F.col("rank")
    late = F.lit(r) + F.floor((rank - r * (q + 1)) / F.lit(max(q, 1)))
    return _numbered(dealt, counts, order, "rank").withColumn("shard", F.when(rank < r * (q + 1), F.floor(rank / (q + 1))).otherwise(late).cast("long"))


def batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    return ranked(df, order).withColumn("batch", F.floor(F.col("rank") / size).cast("long"))


def length_report(df: DataFrame, length: Column, by: str, thresholds: Sequence[int] = THRESHOLDS, cost: int = IMAGE_COST) -> DataFrame:
    """Per group and over all (null): samples, those over each threshold, with shares as text, and the longest."""
    t = df.select(by, (length + cost).cast("long").alias("t"))
    aggs = [F.count("*").alias("valid"), F.coalesce(F.max("t"), F.lit(0)).cast("long").alias("maximum")] + [F.count_if(F.col("t") > x).alias(f"over_{x}") for x in thresholds]
    out = t.rollup(by).agg(F.grouping(by).cast("int").alias("total"), *aggs)
    return out.select(by, "total", "valid", "maximum", *[c for x in thresholds for c in (F.col(f"over_{x}"), N.percentage(F.col(f"over_{x}"), F.col("valid")).alias(f"share_{x}"))])


def compression(df: DataFrame, raw: Column, small: Column, by: str) -> DataFrame:
    """Per group and over all (null): rows, mean length after, reduction in per cent."""
    t = df.select(by, raw.cast("long").alias("a"), small.cast("long").alias("b"))
    out = t.rollup(by).agg(F.grouping(by).cast("int").alias("total"), F.count("*").alias("processed_count"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return out.select(by, "total", "processed_count", F.round(F.col("b") / F.col("processed_count"), 6).alias("avg_length"), F.when(F.col("a") > 0, F.round((F.col("a") - F.col("b")) * 100.0 / F.col("a"), 6)).otherwise(0.0).alias("reduction_percent"))


def latest(df: DataFrame, name: Column, by: str) -> DataFrame:
    """The name with the largest number after its last dash; names without one count as 0, of equals the last."""
    step = F.coalesce(F.regexp_extract(name, r"-(\d+)$", 1).try_cast("long"), F.lit(0))
    return df.groupBy(by).agg(F.max_by(name, F.struct(step, name)).alias("latest"))


def prompt_rows(df: DataFrame, prompts: Sequence[str], debug: bool = False) -> DataFrame:
    """svg, prompt (the prompt columns, nulls skipped) and source; with `debug` also the prompt columns as a struct."""
    missing = [c for c in prompts if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    rows = df.select("svg", F.concat_ws(". ", *prompts).alias("prompt"), "source", *([F.struct(*prompts).alias("prompts"), F.length("svg").alias("raw_length")] if debug else []))
    return rows


def scored_pairs(completions: Column, truths: Column) -> Column:
    """Completions with their truths by place, as many as both have."""
    n = F.least(F.size(completions), F.size(truths))
    pairs = F.arrays_zip(F.slice(completions, 1, n).alias("completion"), F.slice(truths, 1, n).alias("truth"))
    return F.transform(pairs, lambda p: F.struct(p["completion"].alias("completion"), p["truth"].alias("truth")))
