"""A training corpus from raw documents: toxicity, near duplicates, repeated passages, mixture, tokens.

Every stage takes any table with doc_id, text and source, whatever other columns it has and however they are called, and
all but the last return just its columns. Null and repeated ids are rows like others; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, minhash, mixture, queries, substrings, toxicity
from quarry.llm.base import stage, table

#: Texts that share so many hundredths of their word shingles are near duplicates here; op8_minhash has a percent of its own.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels, does not reject; null and empty texts stay."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (NEAR_PERCENT): that of smallest id, nulls last.

    Texts without words all stay; of rows that are equal in every column one stays.
    """
    return minhash.deduplicated(docs, NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences of passages that stand earlier in the corpus, by id and place.

    Null and empty texts stay; documents of which nothing is left go. n_chars, where there is one, fits the new text.
    """
    return substrings.cut(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mixture takes them; those without words once, null sources as one source."""
    return mixture.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix: doc_id, source, n_tokens, digests and ids; a null text has no tokens."""
    return bpe.encode_documents(docs, queries.tokenizer(), keep=("doc_id", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixture", mix_sources),
    ("bpe", encode),
]

#: No stage but the mixture's targets can be said in SQL: models, sampled hashes and a tokenizer decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"stage-{name}")
    return docs
