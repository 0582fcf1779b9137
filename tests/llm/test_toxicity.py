"""Ordinal toxicity: ordered thresholds, held-out labels, every kind of row."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_fit_recovers_an_ordinal_scale():
    rng = np.random.default_rng(1)
    x = (rng.random((2000, 12)) < 0.3).astype(float)
    true = np.r_[2.0, 1.5, -1.0, np.zeros(9)]
    y = np.searchsorted([0.5, 1.5, 2.5], x @ true + rng.logistic(size=2000) * 0.5)
    weights, cuts = toxicity.fit_ordinal(x, y, 4)
    assert (np.diff(cuts) > 0).all()
    assert weights[0] > weights[1] > abs(weights[3:]).max() and weights[2] < 0


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = toxicity.fit(docs, labels.where(fold == 0))
    assert (np.diff(model.cuts) > 0).all()
    got = toxicity.score(docs, model).join(labels.where(fold == 1), "doc_id").toPandas()
    assert (got.severity.between(0, toxicity.GRADES - 1)).all()
    assert got.rejected[got.toxic == 1].mean() >= 0.75  # those with one or two of its words are often missed
    assert got.rejected[got.toxic == 0].mean() <= 0.02


def test_severity_is_the_expected_grade(spark):
    h, _ = toxicity.word_hashes(np.frombuffer(b"bad worse", np.uint8), np.array([0, 9]))
    order = np.argsort(h)
    model = toxicity.Model(h[order], np.array([2.0, 3.0])[order], np.array([1.0, 2.0, 4.0]))
    df = spark.createDataFrame([(1, "BAD, fine"), (2, "bad worse bad"), (3, None), (4, ""), (None, "fine"), (1, "BAD, fine")], "doc_id bigint, text string")
    for r, score in zip(toxicity.score(df, model).collect(), (2.0, 5.0, 0.0, 0.0, 0.0, 2.0), strict=True):
        above = 1 / (1 + np.exp(np.array([1.0, 2.0, 4.0]) - score))
        assert abs(r.severity - above.sum()) < 1e-12 and abs(r.p_toxic - above[0]) < 1e-12


def test_labels_of_one_kind_none_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(10)], "doc_id bigint, text string")
    for value in (None, 0, 1):
        labels = spark.createDataFrame([(i, value) for i in range(10)], "doc_id bigint, toxic int")
        got = toxicity.clean(docs, labels).count()
        assert got == (0 if value == 1 else 10)
    assert toxicity.clean(docs.where("false"), labels.where("false")).collect() == []
    extra = docs.withColumn("severity", F.lit("x"))
    assert toxicity.clean(extra, labels.where("false")).columns == ["doc_id", "text", "severity"]


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([(f"d{i}", "good words. " * 9 if i % 2 else "zz ## qq " * 9) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 40
