"""Sharding: counts, slots, sizes and the mixture of every shard."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import shards


@pytest.fixture(scope="module")
def docs(spark):
    source = lambda i: None if i % 10 == 9 else "hot" if i % 3 else f"s{i % 4}"
    text = lambda i: None if i % 97 == 0 else "" if i % 89 == 0 else "word " * (i % 50)
    rows = [(i // 2 if i < 20 else i, text(i), source(i)) for i in range(1001)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").cache()


def test_rows_law(docs):
    rows = shards.interleave(docs).collect()
    assert len(rows) == 1001
    own = defaultdict(list)
    for r in rows:
        own[r.shard].append(r)
        assert r.law == "rows" and r.grown_shard is None
    count = [len(own[s]) for s in range(24)]
    assert max(count) - min(count) <= 1
    assert all(sorted(r.slot for r in own[s]) == list(range(len(own[s]))) for s in own)
    whole = Counter(r.source for r in rows)
    for s in own:
        mine = Counter(r.source for r in own[s])
        assert all(abs(mine[k] - n * len(own[s]) / 1001) <= 3 for k, n in whole.items())


def test_sizes_and_checksums(docs):
    want = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in shards.interleave(docs).collect()) == want


def test_partitions_do_not_matter(docs):
    key = lambda df: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in df.collect())
    assert key(shards.interleave(docs)) == key(shards.interleave(docs.repartition(7, "text")))


def test_empty_equal_and_clashing(spark, docs):
    assert shards.interleave(docs.where(F.lit(False))).collect() == []
    same = spark.createDataFrame([(1, "a", "x", 5)] * 50, "doc_id bigint, text string, source string, shard int")
    rows = shards.interleave(same).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 50
    assert max(Counter(r.shard for r in rows).values()) == 3


def test_equals_plain_interleaving(spark, docs):
    """Ranks of seeded hashes within each stratum, all rows by fractional rank, cut into equal runs."""
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t")).collect()
    last = lambda v: (v is not None, v)
    crc = lambda t: zlib.crc32(t.encode())
    own = defaultdict(list)
    for r in rows:
        own[r.source].append((int(hashlib.md5(f"0|{r.doc_id}|{r.t}".encode()).hexdigest()[:15], 16), r.doc_id, crc(r.t), len(r.t) + 8))
    placed = []
    for source, members in own.items():
        members.sort()
        placed += [((k + 0.5) / len(members), last(source), m[1], m[2]) for k, m in enumerate(members)]
    placed.sort()
    total = len(placed)
    want, slots = Counter(), defaultdict(int)
    for g, (_, source, doc, c) in enumerate(placed):
        shard = g * 24 // total
        want[doc, c, source[1], shard, slots[shard]] += 1
        slots[shard] += 1
    got = Counter((r.doc_id, r.text_crc32, r.source, r.shard, r.slot) for r in shards.interleave(docs).collect())
    assert got == want

