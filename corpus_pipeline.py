"""From raw documents to encoded training data, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, reads all that its predecessor kept
(written as Parquet and read again) and returns a DataFrame; all but the last
return the columns of ``documents``.

Any column may be null, and further columns may have any names: they are handed on
as they are.  A null text counts as empty; an empty text isn't toxic, and all empty
texts are copies of each other.  A null identifier is a document like any other; it is
smaller than all others for exact dedup (the largest stays) and comes last for
near-dedup (the smallest stays); of rows that repeat an identifier and a text, one
stays.  Null languages and sources are leaves of the mixture like others.  Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matrixloom.llm import bpe, common, exact_dedup, mixing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models, fitted on these documents' labels, don't reject."""
    return toxicity.kept(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest identifier."""
    return exact_dedup.deduped(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar to 0.8 or more."""
    return simhash.one_of_each(docs, n=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mixture over the tokens that are left; a document comes once for
    each epoch that has it."""
    return mixing.mixture(docs).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the decoded text."""
    rows = bpe.encoded(docs, bpe.default_path())
    return bpe.digests(rows)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: No SQL states the scores and the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = common.written(docs, f"stage-{name}")
            if before:
                common.delete(spark, before)
            before = path
    return docs
