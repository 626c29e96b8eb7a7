"""Deterministic samples: the rows with the lowest seeded hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import seeded_rank


def hash_sample(rows: DataFrame, seed: str, kind: str, n: int, id_col: str = "id") -> DataFrame:
    """The ``n`` rows with the lowest hashes, ties by id, with their ``hash``. A bounded heap per task."""
    return rows.withColumn("hash", seeded_rank(seed, kind, id_col)).orderBy("hash", id_col).limit(n)


def fill(rows: DataFrame, mandatory: DataFrame, budget: int, seed: str, id_col: str = "id", strict: bool = True) -> DataFrame:
    """The mandatory rows and, by hash, as many others as the budget has room for; ``mandatory`` says which.

    More mandatory rows than the budget are an error, or, if not ``strict``, all of the result: none is left out.
    """
    must = mandatory.select(id_col).distinct()
    have = rows.join(must, id_col, "left_semi").withColumn("mandatory", F.lit(True))
    room = budget - have.count()
    if room < 0 and strict:
        raise ValueError(f"{-room} mandatory rows above the budget")
    if room <= 0:
        return have
    rest = rows.join(must, id_col, "left_anti").withColumn("mandatory", F.lit(False))
    return have.unionByName(hash_sample(rest, seed, "document", room, id_col).drop("hash"))


def hard_negatives(candidates: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query the first ``k`` ranked rows that are not judged relevant: (query_id, id, position)."""
    rel = qrels.filter("grade > 0").select("query_id", "id")
    order = Window.partitionBy("query_id").orderBy("rank", "id")
    left = candidates.join(rel, ["query_id", "id"], "left_anti").withColumn("position", F.row_number().over(order))
    return left.filter(F.col("position") <= k)


def negatives_quota(candidates: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """``hard_negatives``, of which every query with candidates must have ``k``: a shortfall is an error that names the first such query."""
    found = hard_negatives(candidates, qrels, k)
    have = found.groupBy("query_id").agg(F.count("*").alias("_n"))
    short = candidates.select("query_id").distinct().join(have, "query_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(F.col("_n") < k)
    first = short.orderBy("query_id").limit(1).collect()
    if first:
        raise ValueError(f"query {first[0]['query_id']} has {first[0]['_n']} of {k} hard negatives")
    return found


def dangling(qrels: DataFrame, documents: DataFrame, id_col: str = "id") -> DataFrame:
    """Judgments of documents that do not exist."""
    return qrels.join(documents.select(id_col), id_col, "left_anti")


def corpus_faults(documents: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row of counts that must be zero in a sound corpus."""
    docs = documents.agg((F.count("*") - F.count_distinct("id")).alias("repeated_documents"))
    asked = queries.agg((F.count("*") - F.count_distinct("query_id")).alias("repeated_queries"))
    grades = qrels.agg(F.count_if(F.coalesce(F.col("grade"), F.lit(0)) <= 0).alias("bad_grades"))
    lost = dangling(qrels, documents).agg(F.count("*").alias("dangling_judgments"))
    unjudged = queries.join(qrels, "query_id", "left_anti").agg(F.count("*").alias("unjudged_queries"))
    out = docs
    for other in (asked, grades, lost, unjudged):  # one row each
        out = out.join(F.broadcast(other))
    return out
