"""A training corpus from raw documents: language, near duplicates, repeated passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``run`` writes each stage's result as
Parquet in the shared folder and reads it back for the next.

Defined results, over all stages: a null text, or one without a letter, is rejected by the first; a very long text is
handled whole; a document with a null ``doc_id`` is never a near duplicate, loses passages that any other holds, and is
mixed by its text; a null source is a source of its own; repeated rows stay repeated, and what ties goes to the smaller
id; an empty table gives no rows; all but the last stage return the columns of ``documents`` as they came, further ones
with whatever names included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, langid, minhash, mixing, queries, storage, substring


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model learns from their own labelled part.

    Null texts and texts without a letter go; without any labelled document all go."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: all rows of its smallest id, and those without an id."""
    return minhash.without_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id holds too; one that loses all its words stays, empty."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; one that is taken no time goes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of ids, and digests of its ids and of the text they decode to; an empty text has none."""
    return bpe.digests(docs, queries.tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("mixture", mix_sources),
    ("encoding", encode),
]

#: Language identification and sampling have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
