"""Stages over tables with column names of their own joins, repeated names, null ids and ids shared by texts."""

import pytest

import corpus_pipeline
from quarry.llm import minhash, mixture, quality, shards, substrings, toxicity

NAMES = ["doc_id", "text", "source", "d", "h", "c", "copy", "g", "p", "k", "k1", "h1", "c0", "__pos", "__h", "__k", "component", "best", "n", "text"]


def wide(spark, rows):
    table = spark.createDataFrame([(*r, *[f"{k}-{i}" for k in range(len(NAMES) - 3)]) for i, r in enumerate(rows)], "doc_id bigint, text string, source string, " + ", ".join(f"x{k} string" for k in range(len(NAMES) - 3)))
    return table.toDF(*NAMES)


A = " ".join(f"alpha{i}" for i in range(40))
B = " ".join(f"beta{i}" for i in range(40))
P = "This passage of many words stands in several documents as it is. It has a second sentence with enough words to make a whole run of sentences."


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    rows = [(None, A, "a"), (None, A, "a"), (None, B, "b"), (7, B, "b"), (7, A + " more", "c"), (7, "one two three", "c"), (3, None, "a"), (None, "", "a"), (None, " ", "a")]
    out = minhash.deduplicated(wide(spark, rows))
    assert out.columns == NAMES
    got = sorted(((r[0], r[1]) for r in out.collect()), key=str)
    assert got == sorted([(7, A + " more"), (7, B), (7, "one two three"), (3, None), (None, ""), (None, " ")], key=str)


def test_rows_equal_in_every_column_leave_one(spark):
    table = spark.createDataFrame([(None, A)] * 5 + [(1, B)] * 3, "doc_id bigint, text string")
    assert sorted((r.doc_id or 0) for r in minhash.deduplicated(table).collect()) == [0, 1]


@pytest.mark.parametrize("ids", [(None, None, None), (5, 5, 5), (1, 2, 3)])
def test_a_passage_stays_once_whatever_the_ids(spark, ids):
    texts = [f"{P} Then words that only the first document has.", f"{P} The second one goes on in another way.", "Before it. " + P]
    out = substrings.cut(wide(spark, [(i, t, "a") for i, t in zip(ids, texts, strict=True)]))
    assert out.columns == NAMES
    assert sum(P in r[1] for r in out.collect()) == 1
    assert all(r[19].startswith("16-") and r[3].startswith("0-") for r in out.collect())


def test_names_of_added_columns_are_replaced(spark):
    table = spark.createDataFrame([(1, P, "x", "y"), (2, P + " Words.", "z", "w")], "doc_id bigint, text string, n_removed string, k string")
    out = substrings.deduplicated(table, both_ends=True)
    assert out.columns == ["doc_id", "text", "k", "n_sentences", "n_removed", "n_spans"]
    assert sorted((r.k, r.n_removed > 0) for r in out.collect()) == [("w", True), ("y", False)]


def test_mixed_and_empty(spark):
    table = wide(spark, [(1, "a b", "s"), (None, None, None)])
    assert mixture.mixed(table).columns == NAMES
    for stage in (minhash.deduplicated, substrings.cut, mixture.mixed):
        assert stage(table.where("false")).collect() == []


def test_every_stage_takes_any_columns(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    rows = [(i if i % 4 else None, f"{A if i % 2 else B} {i} {P}", "s" if i % 3 else None) for i in range(20)]
    docs = wide(spark, rows)
    assert toxicity.clean(docs, labels).columns == NAMES
    for name, apply in corpus_pipeline.STAGES[1:]:
        docs = apply(spark, docs, "")
        assert docs.columns == NAMES if name != "bpe" else {"doc_id", "source", "ids"} <= set(docs.columns)
        assert docs.count() > 0


def test_very_long_texts(spark):
    long = "word " * 400_000 + "bad"
    docs = spark.createDataFrame([(1, long, "a"), (2, "bad word", "a"), (3, "word", None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id bigint, toxic int")
    assert {r.doc_id: r.p_toxic for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}.keys() == {1, 2, 3}
    assert {r.doc_id: r.size for r in shards.interleave(docs).collect()} == {1: len(long) + 8, 2: 16, 3: 12}
    assert {r.doc_id: r.size for r in mixture.mix(docs).collect()} == {1: 400_001, 2: 2, 3: 1}
    assert quality.score(docs, quality.fit(docs, labels.withColumnRenamed("toxic", "quality"))).count() == 3
