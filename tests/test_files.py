"""Scans of files that are odd, images in all their types, pictures drawn, and streams with late rows."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import sinks, sources, streaming
from quarry.operators import raster


def png(px, kind=2, palette=None, alpha=b""):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    h, w = px.shape[:2]
    rows = b"".join(b"\0" + bytes(row.astype(np.uint8).ravel().tolist()) for row in px)
    out = sources.images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
    out += chunk(b"PLTE", palette) if palette else b""
    out += chunk(b"tRNS", alpha) if alpha else b""
    return out + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_types():
    r = np.random.default_rng(1)
    rgb = r.integers(0, 256, (5, 4, 3))
    assert (sources.decode_png(png(rgb)) == rgb).all()
    gray = r.integers(0, 256, (3, 2, 1))
    assert (sources.decode_png(png(gray, 0)) == np.repeat(gray, 3, 2)).all()
    clear = np.dstack([rgb, np.zeros((5, 4), int)])
    assert (sources.decode_png(png(clear, 6)) == 255).all()
    index = np.array([[[0], [1]]])
    got = sources.decode_png(png(index, 3, bytes([10, 20, 30, 40, 50, 60]), bytes([255, 0])))
    assert got.tolist() == [[[10, 20, 30], [255, 255, 255]]]


@pytest.mark.parametrize("data", [b"", b"text", sources.images.SIGNATURE, png(np.zeros((1, 1, 3)))[:40]])
def test_what_is_no_image_has_an_error(spark, data):
    (row,) = sources.pixels(spark.createDataFrame([(1, bytearray(data))], "id int, content binary")).collect()
    assert row.px is None and row.error


def test_scan_options():
    o = sources.ScanOptions.of({"datasets": "a, ,b", "shards": "3", "shard": "1", "force": "TRUE", "limit": " "})
    assert (o.datasets, o.shard, o.shards, o.force, o.limit) == (("a", "b"), 1, 3, True, None)
    with pytest.raises(ValueError, match="shard"):
        sources.ScanOptions.of({"shards": "2", "shard": "2"})


def test_shards_part_the_rows(spark):
    df = spark.range(500).select(F.col("id"), F.lit("d").alias("dataset"))
    parts = [{r.id for r in sources.ScanOptions(shard=k, shards=4).scan(df, "dataset", "id").collect()} for k in range(4)]
    assert set().union(*parts) == set(range(500)) and sum(map(len, parts)) == 500 and all(parts)


def test_json_of_an_empty_file(spark):
    path = sinks.scratch(spark, "none")
    spark.createDataFrame([("",)], "value string").write.text(path)
    assert sources.json_records(spark, path, "a int").where("a is not null").count() == 0


def test_raster_edges():
    white = raster.render('<svg width="4" height="4"><rect width="0" height="2"/><text>x</text><g display="none"><rect width="4" height="4"/></g></svg>')
    assert (white == 255).all()
    half = raster.render('<svg width="4" height="4"><rect width="4" height="4" fill="#000" opacity="0.5"/></svg>')
    assert set(half.ravel().tolist()) == {128}
    fitted = raster.render('<svg viewBox="0 0 2 1"><rect width="2" height="1" fill="red"/></svg>', (8, 8))
    assert ((fitted == [255, 0, 0]).all(2)).sum() == 32 and (fitted[:2] == 255).all()
    for bad in ("", "<g/>", "<svg/>", '<svg viewBox="0 0 0 1"/>', "<svg width='9'"):
        with pytest.raises(ValueError, match="."):
            raster.render(bad)


@pytest.mark.parametrize(("text", "want"), [("#fff", (255, 255, 255)), ("rgb(1, 2,300)", (1, 2, 255)), ("none", None), (None, None), ("url(#a)", None), ("Red", (255, 0, 0))])
def test_colours(text, want):
    assert raster.colour(text) == want


def test_late_rows_are_dropped(spark):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    source, target, seen = (sinks.scratch(spark, f"late-{k}") for k in ("in", "out", "seen"))
    schema = "ts timestamp_ntz, k string, v double"
    step = lambda df: streaming.windowed_counts(df, "ts", "k", "v", "1 hour", "10 minutes")
    kind = spark.createDataFrame([], schema).schema
    for rows in ([(at(1), "a", 1.0), (at(5), "a", 2.0)], [(at(1, 30), "a", 9.0), (at(9), "a", 3.0)], [(at(12), "a", 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streaming.run_available(spark, source, kind, target, seen, step)
    got = sorted((r.start.hour, r.n, r.total) for r in spark.read.parquet(target).collect())
    assert got == [(1, 1, 1.0), (5, 1, 2.0), (9, 1, 3.0)]
