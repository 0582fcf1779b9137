"""Queries that write tables as files and scan them again, and streams over files."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import sinks, sources, streaming

from .registry import query, read


@query("manifest_scan", "select distinct url id from pages where url <> ''")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Ids are the first words of lines; blank lines have none."""
    path = sinks.scratch(spark, "manifest")
    line = F.concat(F.lit("  "), F.col("url"), F.lit(" 7 more\n\n \t"))
    read(spark, d, "pages").select(line.alias("value")).write.text(path)
    return sources.manifest_ids(spark, path).distinct()


@query("id_list_scan", "select distinct c_custkey id from customer where c_custkey % 3 <> 0")
def id_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose ids a written list has; ids stand there twice and padded."""
    path = sinks.scratch(spark, "ids")
    c = read(spark, d, "customer").select("c_custkey")
    twice = c.unionAll(c).withColumn("line", F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")))
    sinks.write_ids(twice, path, "line", F.col("c_custkey") % 3 != 0)
    ids = sources.id_list(spark, path).select(F.col("id").cast("long").alias("id"))
    return c.withColumnRenamed("c_custkey", "id").join(ids, "id", "left_semi")


@query("chart_files", "select n_nationkey::varchar id, 'line of ' || n_name || chr(10) || 'second' text from nation where n_regionkey <> 2")
def chart_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder of texts and one of images for each chart; charts that have both, and their whole texts."""
    n = read(spark, d, "nation")
    text, image = sinks.scratch(spark, "charts"), sinks.scratch(spark, "images")
    sinks.write_texts(n.select(F.col("n_nationkey").alias("chart"), F.concat(F.lit("line of "), F.col("n_name"), F.lit("\nsecond")).alias("t")), text, "chart", "t")
    sinks.write_texts(n.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("chart"), F.lit("png").alias("t")), image, "chart", "t")
    charts, images = (sources.chart_ids(spark, p, r"chart=([^/]+)/") for p in (text, image))
    found = sources.whole_texts(spark, text, r"chart=([^/]+)/").join(sources.with_both(charts, images), "id", "left_semi")
    return found.withColumn("text", F.regexp_replace("text", r"\n$", ""))


@query("zip_members", "select 'raw/charts/' || n_nationkey || '/svg.txt' member, n_name || ' é' || n_nationkey text from nation union all select 'b.txt', 'b' from region")
def zip_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of archives, one for each region; folders, other suffixes and what is no archive give none."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for found in batch.column("members").to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("raw/", "")
                    z.writestr("b.txt", "b")
                    z.writestr("c.bin", "no")
                    for m in found:
                        z.writestr(m["name"], m["text"])
                made.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.binary())], ["path", "content"])

    n = read(spark, d, "nation")
    name = F.concat(F.lit("raw/charts/"), F.col("n_nationkey").cast("string"), F.lit("/svg.txt"))
    own = F.struct(name.alias("name"), F.concat(F.col("n_name"), F.lit(" é"), F.col("n_nationkey").cast("string")).alias("text"))
    per = n.groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.collect_list(own).alias("members"))
    per = read(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("path")).join(per, "path", "left").select("path", F.coalesce("members", F.array().cast("array<struct<name:string,text:string>>")).alias("members"))
    files = per.mapInArrow(archive, "path string, content binary")
    broken = spark.createDataFrame([("x", bytearray(b"none")), ("y", None)], "path string, content binary")
    return sources.zip_members(files.unionAll(broken), ".txt").select("member", "text")


_NATIONS = "select n_nationkey::bigint n_nationkey, n_name, case when n_regionkey = 0 then null else n_regionkey end::bigint as region from nation"


@query("json_array_scan", _NATIONS)
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records from one JSON array; keys that a record lacks are null."""
    path = sinks.scratch(spark, "array")
    n = read(spark, d, "nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(0)).alias("region"))
    sinks.write_array(n, path, ["n_nationkey"])
    return sources.json_records(spark, path, "n_nationkey long, n_name string, region long")


@query("json_lines_scan", _NATIONS)
def json_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same scan over one object a line."""
    path = sinks.scratch(spark, "lines")
    n = read(spark, d, "nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(0)).alias("region"))
    sinks.write_summary(n, path)
    return sources.json_records(spark, path, "n_nationkey long, n_name string, region long")


@query(
    "split_files",
    """
    select lang, source, doc_id, n_chars from (select *, row_number() over (partition by lang, source order by doc_id desc) k from documents) where k = 1""",
)
def split_files(spark: SparkSession, d: str) -> DataFrame:
    """One file for each key, the last record of it, read again from all folders below."""
    path = sinks.scratch(spark, "split")
    docs = read(spark, d, "documents").select("lang", "source", "doc_id", "n_chars", F.col("lang").alias("l"), F.col("source").alias("s"))
    sinks.write_by_key(docs, path, ["l", "s"], ["doc_id"])
    return sources.json_files(spark, path, "lang string, source string, doc_id long, n_chars long").drop("file")


@query(
    "record_files",
    """
    select case n_regionkey when 1 then 'graphiq' else 'echarts' end dataset, n_name || ' "x"' as said, 'images/' || n_nationkey || '.png' image from nation""",
)
def record_files(spark: SparkSession, d: str) -> DataFrame:
    """Chat records as JSON lines below the output name of their data set; that name comes back as a column."""
    from quarry.operators import records

    path = sinks.scratch(spark, "records")
    n = read(spark, d, "nation")
    image = F.concat(F.lit("images/"), F.col("n_nationkey").cast("string"), F.lit(".png"))
    dataset = F.when(F.col("n_regionkey") == 1, "graphiq_clean").otherwise("echarts")
    sinks.write_records(n.select(dataset.alias("dataset"), records.chat_record(F.concat("n_name", F.lit(' "x"')), image).alias("r")).select("dataset", "r.*"), path)
    back = spark.read.schema("dataset string, messages array<struct<role:string,content:string>>, images array<string>").json(path)
    return back.where(F.size("images") > 0).select("dataset", F.element_at("messages", -1)["content"].alias("said"), F.col("images")[0].alias("image"))


@query("csv_report", """select n_nationkey::bigint id, n_name || ', "q"' || chr(10) || 'x' as remark, n_regionkey / 4.0::double score from nation""")
def csv_report(spark: SparkSession, d: str) -> DataFrame:
    """A report as CSV with a header, read again: quotes, commas and line breaks stay."""
    path = sinks.scratch(spark, "report")
    n = read(spark, d, "nation")
    sinks.write_report(n.select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(', "q"\nx')).alias("remark"), (F.col("n_regionkey") / 4.0).alias("score")), path)
    return spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").schema("id long, remark string, score double").csv(path)


@query(
    "metric_csv",
    """
    with m as (select lang, count(*)::double n, avg(n_chars) mean from documents group by lang)
    select lang, 'processed_count' metric, n as value from m union all select lang, 'avg_length', round(mean, 6) from m union all select lang, 'reduction_percent', null from m""",
)
def metric_csv(spark: SparkSession, d: str) -> DataFrame:
    """A row for each metric; a metric without a value comes back as null."""
    path = sinks.scratch(spark, "metrics")
    m = read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("processed_count"), F.round(F.avg("n_chars"), 6).alias("avg_length"), F.lit(None).cast("double").alias("reduction_percent"))
    sinks.write_report(sinks.metric_rows(m, "lang", ["processed_count", "avg_length", "reduction_percent"]), path)
    return spark.read.option("header", "true").schema("lang string, metric string, value double").csv(path)


@query(
    "append_history",
    """select c_custkey, 'run 1: ' || c_name || '; run 2: ' || c_mktsegment || case when c_custkey % 2 = 0 then '; run 3: ' || c_custkey else '' end entries from customer""",
)
def append_history(spark: SparkSession, d: str) -> DataFrame:
    """Three runs append entries; each key's come back in order of time, however they were written."""
    path = sinks.scratch(spark, "history")
    c = read(spark, d, "customer")
    at = lambda k: F.timestamp_seconds(F.lit(1_700_000_000 + k))
    sinks.append_history(c.select("c_custkey", F.concat(F.lit("run 2: "), F.col("c_mktsegment")).alias("said")), path, at(2))
    sinks.append_history(c.select("c_custkey", F.concat(F.lit("run 1: "), F.col("c_name")).alias("said")), path, at(1))
    sinks.append_history(c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("run 3: "), F.col("c_custkey").cast("string")).alias("said")), path, at(3))
    said = F.array_join(F.transform("entries", lambda e: e["said"]), "; ")
    return sinks.history(spark, path, "c_custkey").select("c_custkey", said.alias("entries"))


@query("saved_split", "select doc_id, lang from documents where doc_id % 10 <> 0")
def saved_split(spark: SparkSession, d: str) -> DataFrame:
    """A data set written with its splits; only the files of the split that is asked for are read."""
    path = sinks.scratch(spark, "saved")
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    sinks.save(read(spark, d, "documents").select("doc_id", "lang", split.alias("split")), path)
    return sources.saved(spark, path, "train")


@query(
    "png_pixels",
    """
    with a as (select p_partkey k, p_size % 7 + 1 w, p_partkey % 5 + 1 h, p_size * 5 r, p_partkey % 256 g from part)
    select k p_partkey, case when k % 9 <> 8 then h end::int height, case when k % 9 <> 8 then w end::int width,
        case when k % 9 <> 8 then w * h * (case when k % 2 = 0 then (r * 128 + 255 * 127 + 127) // 255 else r end) end::bigint red,
        case when k % 9 <> 8 then w * h * (case when k % 2 = 0 then (g * 128 + 255 * 127 + 127) // 255 else g end) end::bigint green, k % 9 = 8 as failed from a""",
)
def png_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Images of one colour, some half transparent, in each of the format's filters; what is no image has an error."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        for batch in batches:
            out = []
            for k, w, h, r, g in zip(*(batch.column(c).to_pylist() for c in ("p_partkey", "w", "h", "r", "g")), strict=True):
                n = 4 if k % 2 == 0 else 3
                pixel = bytes([r, g, 7, 128][:n])
                rows, above = b"", bytes(w * n)
                for y in range(h):
                    row, kind = pixel * w, (k + y) % 5
                    rows += bytes([kind])
                    for i, x in enumerate(row):
                        a, b, c = (row[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
                        p = a + b - c
                        near = min((abs(p - v), q) for q, v in enumerate((a, b, c)))[1]
                        rows += bytes([(x - (0, a, b, (a + b) // 2, (a, b, c)[near])[kind]) % 256])
                    above = row
                head = struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)
                out.append(b"text" if k % 9 == 8 else b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
            yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), pa.array(out, pa.binary())], ["p_partkey", "content"])

    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 7 + 1).alias("w"), (F.col("p_partkey") % 5 + 1).alias("h"), (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).alias("g"))
    found = sources.pixels(p.mapInArrow(made, "p_partkey long, content binary"))
    total = lambda at: F.aggregate(F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.conv(F.hex(F.substring("px", i * 3 + at, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("p_partkey", "height", "width", F.when(F.col("px").isNotNull(), total(1)).alias("red"), F.when(F.col("px").isNotNull(), total(2)).alias("green"), F.col("error").isNotNull().alias("failed"))


@query(
    "scan_options",
    "select p_partkey, p_brand from part where p_partkey in (select p_partkey from part order by p_partkey offset 3 limit 50) and p_brand in ('Brand#12', 'Brand#23') order by p_partkey",
)
def scan_options(spark: SparkSession, d: str) -> DataFrame:
    """Rows by a slice and by data set, as settings in text ask for them."""
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    part = sources.ScanOptions.of({"start": "3", "limit": "50"}).scan(p, "p_brand", "p_partkey")
    return sources.ScanOptions.of({"datasets": " Brand#12,, Brand#23 ", "ids": ""}).scan(part, "p_brand", "p_partkey")


@query("incremental_stream", "select event_id, event_type, round(value * 2, 6) doubled from events")
def incremental_stream(spark: SparkSession, d: str) -> DataFrame:
    """Files that arrive between two runs: each run takes only the new ones, and every row comes out once."""
    source, target, seen = (sinks.scratch(spark, f"stream-{k}") for k in ("in", "out", "seen"))
    events = read(spark, d, "events").select("event_id", "event_type", "value")
    step = lambda df: df.select("event_id", "event_type", F.round(F.col("value") * 2, 6).alias("doubled"))
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(source)
        streaming.run_available(spark, source, events.schema, target, seen, step)
    streaming.run_available(spark, source, events.schema, target, seen, step)
    return spark.read.parquet(target)


@query(
    "windowed_stream",
    """
    select epoch(time_bucket(interval '1 hour', ts))::bigint as start, event_type, count(*)::bigint n, round(sum(value), 4) total, max(value) top from events group by all""",
)
def windowed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts by hour over a stream of files; a watermark behind all of the rows drops none of them."""
    source, seen = (sinks.scratch(spark, f"windows-{k}") for k in ("in", "seen"))
    read(spark, d, "events").select("ts", "event_type", "value").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(source)
    counts = streaming.windowed_counts(stream, "ts", "event_type", "value", "1 hour", "3650 days")
    name = f"windows_{source[-32:]}"
    run = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", seen).trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.table(name)
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "top")


@query(
    "turn_states",
    """
    with t as (select conv_id, turn, coalesce("text", '') like '%a%' as calls, row_number() over (partition by conv_id order by turn) k from conversations where role = 'assistant'),
    e as (select conv_id, min(k) filter (not calls or k >= 3) as last, count(*) n from t group by conv_id)
    select c.conv_id, coalesce(least(e.last, e.n), e.n, 0)::int steps, e.last is not null as finished from (select distinct conv_id from conversations) c left join e using (conv_id)""",
)
def turn_states(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns of each conversation until one calls no tool or three are done; a turn with an a in it calls one."""
    source, seen = (sinks.scratch(spark, f"turns-{k}") for k in ("in", "seen"))
    turns = read(spark, d, "conversations")
    said = F.when(F.col("text").contains("a"), F.lit("Action: x")).otherwise("done")
    turns.select("conv_id", "turn", "role", said.alias("text")).write.parquet(source)
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(source)
    name = f"turns_{source[-32:]}"
    run = streaming.scheduled_turns(stream, "conv_id", 3).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", seen).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("chart_table", "select p_partkey, 'echarts' as dataset, '<svg>' || p_size || '</svg>' svg from part where p_partkey % 3 = 1")
def chart_table(spark: SparkSession, d: str) -> DataFrame:
    """Charts written by data set and read again for one of them: the folders of the others are not opened."""
    path = sinks.scratch(spark, "table")
    name = F.element_at(F.array(F.lit("plotly_export"), F.lit("echarts"), F.lit("fusion_clean")), (F.col("p_partkey") % 3 + 1).cast("int"))
    svg = F.concat(F.lit("<svg>"), F.col("p_size").cast("string"), F.lit("</svg>"))
    sinks.write_charts(read(spark, d, "part").select("p_partkey", name.alias("dataset"), svg.alias("svg")), path)
    return spark.read.schema("p_partkey long, svg string, dataset string").parquet(path).where("dataset = 'echarts'").select("p_partkey", "dataset", "svg")


@query(
    "sharded_scan",
    """
    with h as (select c_custkey, c_name, list_reduce(list_prepend(0::bigint, list_transform(string_split(c_custkey::varchar, ''), lambda x: unicode(x)::bigint)), lambda a, x: (a * 31 + x) & 4294967295) h from customer)
    select c_custkey, (h % 3)::int shard from h where c_custkey <> 7""",
)
def sharded_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every shard of a scan, by the stable hash of the id as text; the shards part the rows."""
    c = read(spark, d, "customer").where("c_custkey <> 7").select("c_custkey")
    parts = [sources.ScanOptions.of({"shards": "3", "shard": str(k)}).scan(c, "c_custkey", "c_custkey").withColumn("shard", F.lit(k)) for k in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
