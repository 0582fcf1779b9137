"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import columns, shuffled, stage

#: Rows that one task ranks together, about.
RANKED = 20_000


def interleave(docs: DataFrame, shards: int = 24, seed: int = 0, strata: str = "source") -> DataFrame:
    """Cut `docs` into shards whose row counts differ by one at most and whose strata match the whole's mixture.

    Rows are shuffled within each stratum by a seeded hash and ranked there; all rows are then sorted by fractional
    rank (rank + 1/2) / (rows of the stratum) and cut into `shards` runs. So every run of consecutive rows holds each
    stratum in proportion, to within a row or so.

    Both ranks are taken without gathering a stratum: rows are dealt by the high bits of the hash (and then by
    fractional rank), which spreads a stratum of any size evenly, counts of these small ranges are summed up to offsets,
    and row numbers are taken inside each range. Texts are read once for size and checksum and never shuffled.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32, law ("rows"), shard, slot (gapless
    from 0 in each shard), grown_shard (null: this law says nothing about one more shard) and the stratum. Null strata
    are one stratum; null texts are empty; rows equal in all of these columns can be told apart by nothing and fill
    neighbouring ranks in any order; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = columns(docs, ["doc_id", "text", strata]).select(
        "doc_id",
        F.col(strata).alias("stratum"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shuffled(seed, F.col("doc_id"), text).alias("h"),
    )
    rows = stage(rows, "shards")
    total = rows.count()
    ranges = max(256, -(-total // RANKED))
    spread = lambda name: F.floor(F.col(name) * F.lit(2.0**-60) * ranges).alias("part")
    rows = rows.select("*", spread("h"))

    counts = rows.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    own = W.partitionBy("stratum")
    counts = counts.select(
        F.col("stratum").alias("s"),
        F.col("part").alias("p"),
        (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(own).alias("of"),
    )
    order = ["h", "doc_id", "text_crc32", "size"]
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("stratum", "part").orderBy(*order)) - 1).join(
        counts, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    )
    ranked = ranked.select(
        "doc_id", "size", "text_crc32", "stratum", ((F.col("before") + F.col("k") + 0.5) / F.col("of")).alias("at")
    ).withColumn("part", F.floor(F.col("at") * ranges))
    ranked = stage(ranked, "shards-at")

    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each range: a number that depends on RANKED and is far below that of the rows.
    counts = counts.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("at", "stratum", "doc_id", "text_crc32", "size")) - 1
    placed = ranked.withColumn("k", place).join(counts, F.col("part") == F.col("p")).withColumn("g", F.col("before") + F.col("k"))
    placed = placed.withColumn("shard", F.expr(f"g * {shards} div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shard * cast({max(total, 1)} as bigint) + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("g") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias(strata)
    )
