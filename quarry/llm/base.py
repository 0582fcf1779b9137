"""What the operators of this subpackage share: tables, the shared folder, text buffers, components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one the context has been given.

    Only a session whose executors are threads of the driver gets a folder of our own; elsewhere one must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; it is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session is gone: its folder is the cluster's to clean
            return


def columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only the wanted columns; where a table has two of one name (clashing extras), the first counts."""
    if len(set(df.columns)) == len(df.columns):
        return df.select(*wanted)
    seen: dict[str, int] = {}
    names = []
    for i, c in enumerate(df.columns):
        names.append(c if c not in seen else f"__extra_{i}")
        seen.setdefault(c, i)
    return df.toDF(*names).select(*wanted)


def placed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with its columns named by place (c0, c1, ...), so that no name clashes, and the names they had."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def place_of(names: list[str], wanted: str) -> str:
    return f"c{names.index(wanted)}"


def row_hash(seed: int, *cols: str) -> Column:
    """64 bits of hash of some columns; where nulls are counts too. Two seeds give 128 bits."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    return F.xxhash64(F.lit(seed), nulls, *[F.col(c) for c in cols])


def shuffled(seed: int, doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 of seed, id and text: a shuffle that any engine can say again."""
    own = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


# --- text columns as byte buffers -------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (nulls: empty) and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library: freed memory stays with the process
    _trim = None


def release() -> None:
    """Give freed memory back to the system; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def portions(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, as batches of at most `limit` bytes of text, or one row.

    What is worked out for each byte or word of a batch takes many times its size, so batches must not be large.
    """
    for batch in batches:
        at = utf8(batch.column(column))[1]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        release()
    release()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix64(np.arange(1, 257, dtype=_U))
_power = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse modulo 2^64."""
    if len(_power[0]) < n:
        size = max(n, _CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(size, base, _U)
            full[0] = 1
            _power[k] = np.multiply.accumulate(full)
    return _power[0][:n], _power[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are sorted, do not overlap and may be of any length."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(_BYTE[data[lo:hi]] * up[:-1], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix64(out ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal neighbouring keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.r_[0, cut], np.r_[cut, len(keys)]


# --- connected components -----------------------------------------------------------------------------------------


#: A node's links are dealt to so many tasks where they meet its least neighbour.
SALT = 16


def _meet(links: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """Links (u, v) with m, the least neighbour of the node in `key`, or null.

    The least ones, one row a node, come SALT times, and links are dealt by both ends; so a node that very many link to
    is not one task's.
    """
    other = "v" if key == "u" else "u"
    salted = least.select(F.col("u").alias("w"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    dealt = links.withColumn("t", F.pmod(F.xxhash64(other), F.lit(SALT)).cast("int"))
    same = (F.col(key) == F.col("w")) & (F.col("t") == F.col("s"))
    return dealt.hint("merge").join(salted.hint("merge"), same, "left").select("u", "v", "m")


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the links in the first two columns (long).

    Alternates large-star and small-star steps over links (u, v) with u > v, each a min by node (combined before the
    shuffle) and a join back (see _meet); the links shrink to stars in a number of rounds logarithmic in the longest
    path. Nodes without a link to another node do not appear.
    """
    a, b = edges.columns[:2]
    now = checkpoint(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    seen = None
    for _ in range(most):
        # Large star: each larger neighbour of v links to the least of v and its neighbours.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        large = _meet(now, "v", least).select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: u and all of its smaller neighbours link to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _meet(large, "u", least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        got = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
