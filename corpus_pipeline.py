"""The corpus pipeline: documents through five operators, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, neardup, pii, quality
from lodestone.llm.common import keep, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labelled rows of these documents, does not reject.

    Defined cases: null and empty texts are scored as empty ones; repeated rows are judged alike; without labelled rows of both
    kinds all rows get one verdict, that of the kind there is, and stay where there is none; columns stay as they are.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least doc_id.

    Defined cases: null and empty texts are equal; rows that share doc_id and text are one; columns stay as they are.
    """
    return neardup.one_of_each(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data or the terms that disclose it; n_chars is that of the new text.

    Defined cases: a null text stays null, and so its n_chars; rows, ids and other columns stay as they are.
    """
    return _counted(pii.sanitise(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or the parts of them, that the mixture takes, once for each pass; n_chars is that of the part.

    Defined cases: documents without words are not taken; a null source is a source; other columns stay as they are.
    """
    return _counted(mixing.mixture(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text: doc_id, ids, n_tokens.

    Defined cases: a null text is empty; every row has a row of its own; other columns are left out.
    """
    return bpe.encode(docs, decoded=False).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where there is such a column, as the texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", sanitised), ("mixing", mixed), ("bpe", encoded)]

#: Training, sampling and merging can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
