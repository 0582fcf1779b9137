"""Line CRF: marginals equal enumeration of all labellings; held-out labels; every kind of row."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality

DATA = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    of = np.repeat([0, 1, 2], [1, 5, 3])
    score, move = rng.normal(size=9), rng.normal(size=(2, 2))
    good, expected, log_z = quality.marginals(score, of, move, pairs=True)
    want, moves, total = np.zeros(9), np.zeros((2, 2)), 0.0
    for row in range(3):
        at = np.flatnonzero(of == row)
        z, own, own_moves = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(at)):
            p = np.exp(sum(score[i] for i, x in zip(at, labels, strict=True) if x) + sum(move[a, b] for a, b in itertools.pairwise(labels)))
            z += p
            own += p * np.array(labels)
            for a, b in itertools.pairwise(labels):
                own_moves[a, b] += p
        want[at] = own / z
        moves += own_moves / z
        total += np.log(z)
    assert np.allclose(good, want) and np.allclose(expected, moves) and np.isclose(log_z, total)


def test_lines_of_rows():
    data = "a\nbb\n".encode() + b"" + b"ccc"
    starts, ends, of = quality.lines(np.frombuffer(data, np.uint8), np.array([0, 5, 5, 8]))
    assert [(s, e, o) for s, e, o in zip(starts, ends, of, strict=True)] == [(0, 1, 0), (2, 4, 0), (5, 5, 0), (5, 5, 1), (5, 8, 2)]


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    a, b = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (a[:, None] > b[None, :]).mean() >= 0.85
    assert ((held.score >= 0.7).astype(int) == held.predicted).all()


def test_held_out_rows_are_never_learnt(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_null_empty_long_and_clashing(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "\n" * 3000, 3), (4, "x " * 200_000, 4), (None, "a. b", 5), (2, "", 2)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score == rows[5].score
    assert quality.score(docs.where("false"), quality.fit(docs, labels)).collect() == []


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([(f"d{i}", "good words. " * 9 if i % 2 else "zz ## qq " * 9) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, quality int")
    assert quality.score(docs, quality.fit(docs, labels)).count() == 40
