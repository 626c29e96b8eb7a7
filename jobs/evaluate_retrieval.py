"""Lexical retrieval of passages, judged, measured and mined for hard negatives.

Every query is searched for in all documents; a document of its list is relevant if it holds the query's words, one after the
other. Two Parquet tables come out:

  ranking   query_id, id, rank, score, relevant, negative, and by folder the documents' partition column: the first ``depth``
            documents; ``negative`` numbers the best ones that are not relevant, up to ``negatives`` of a query, and is 0 else
  metrics   query_id, hits, recall, mrr, ndcg (at 10, among the relevant ones of the list), shortfall (negatives that are missing),
            and by folder, whether the query has relevant documents at all (judged)

A run replaces both tables as a whole.

    python -m jobs.evaluate_retrieval --documents PATH --queries PATH --output PATH [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import shared, text
from lodestone.operators import evaluate, lexical, sampling

log = logging.getLogger("jobs.evaluate_retrieval")
CONFIG = os.path.join(os.path.dirname(__file__), "evaluate_retrieval.json")


def configuration(path: str | None = None) -> dict:
    with open(path or CONFIG, encoding="utf-8") as f:
        return json.load(f)


def spelt(words: Column) -> Column:
    """Tokens with a space before and behind each, so that one list of words is looked up in another."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def judged(ranked: DataFrame, documents: DataFrame, queries: DataFrame, config: dict) -> DataFrame:
    """``ranked`` with the document's partition column and whether it is relevant. Only listed documents are tokenized."""
    docs = documents.select(F.col(config["document_id"]).alias("id"), F.col(config["document_text"]).alias("_d"), config["partition"])
    asked = queries.select(F.col(config["query_id"]).alias("query_id"), F.col(config["query_text"]).alias("_q"))
    listed = ranked.join(docs, "id").join(asked, "query_id")
    return listed.withColumn("relevant", F.contains(spelt(text.tokens("_d")), spelt(text.tokens("_q")))).drop("_d", "_q")


def run(spark: SparkSession, documents: str, queries: str, output: str, config: dict) -> dict:
    """Search, judge and measure; how many rows were read and written.

    Defined cases: rows without an id are left out; a null or empty text has no words; a query without words or known words
    has no list and no measures; ids must be unique in both tables.
    """
    docs = spark.read.parquet(documents).filter(F.col(config["document_id"]).isNotNull())
    asked = spark.read.parquet(queries).filter(F.col(config["query_id"]).isNotNull())
    held = docs.count()
    log.info("read %d documents of %s", held, documents)
    ranked = lexical.bm25_of_queries(docs, asked, config["query_id"], config["query_text"], config["depth"], config["document_id"], config["document_text"])
    lists = shared.kept(judged(ranked, docs, asked, config), "evaluate-lists")
    grades = lists.filter("relevant").select("query_id", "id", F.lit(1).alias("grade"))
    negatives = sampling.hard_negatives(lists, grades, config["negatives"]).select("query_id", "id", F.col("position").alias("negative"))
    ranking = lists.join(negatives, ["query_id", "id"], "left").select("query_id", "id", "rank", F.round("score", 6).alias("score"), "relevant", F.coalesce("negative", F.lit(0)).alias("negative"), config["partition"])
    _replace(ranking, f"{output}/ranking", config["partition"])
    counts = lists.groupBy("query_id").agg(F.count_if("relevant").alias("hits"))
    mined = negatives.groupBy("query_id").agg(F.count("*").alias("_mined"))
    values = [F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")]
    metrics = counts.join(evaluate.metrics(lists, grades), "query_id", "left").join(mined, "query_id", "left").select(
        "query_id", "hits", *values, (F.lit(config["negatives"]) - F.coalesce("_mined", F.lit(0))).alias("shortfall"), (F.col("hits") > 0).alias("judged")
    )
    _replace(metrics, f"{output}/metrics", "judged")
    wrote = {name: spark.read.parquet(f"{output}/{name}").count() for name in ("ranking", "metrics")}
    log.info("wrote %d listed documents and the measures of %d queries to %s", wrote["ranking"], wrote["metrics"], output)
    return {"documents": held, "queries": asked.count(), **wrote}


def _replace(rows: DataFrame, folder: str, by: str) -> None:
    rows.repartition(by, "query_id").sortWithinPartitions(by, "query_id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(folder)


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="evaluate_retrieval", description=__doc__.splitlines()[0])
    for name in ("documents", "queries", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evaluate_retrieval").getOrCreate()
    try:
        run(spark, args.documents, args.queries, args.output, configuration(args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
