"""The corpus pipeline: every stage takes effect on what the one before kept."""

import corpus_pipeline
from quarry.llm.base import stage, table
from tests.llm.test_minhash import by_brute_force, edited

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "substrings", "mixture", "bpe"]
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, DATA), f"test-{name}")
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= before.keys() and rows
        if name != "bpe":
            assert docs.columns == columns
        if name in ("toxicity", "minhash"):
            assert all(r.text == before[r.doc_id] for r in rows)
        if name == "minhash":
            assert len(rows) < len(before)
        before = {r.doc_id: None if name == "bpe" else r.text for r in rows}


def test_an_empty_table(spark):
    docs = table(spark, DATA, "documents").where("false")
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, DATA), f"test-{name}")
        assert docs.count() == 0


def test_the_near_duplicate_stage_links_from_80_percent_on(spark):
    rows = edited(6)
    docs = spark.createDataFrame([(d, t, "a") for d, t in rows], "doc_id long, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["minhash"](spark, docs, DATA)
    want = by_brute_force(rows, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x for x in want.values()})
    assert len(set(want.values())) < len(set(by_brute_force(rows, 85).values()))
