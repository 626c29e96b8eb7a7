"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfor import read_documents, write_segments

    return read_documents(write_segments(table(spark, sf_dir, "documents")))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    rows = table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.filter("vec_id % 100 = 0"), k=10, scale=1024.0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=16)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keep")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests

    return digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


def planted_order(doc_id, n: int) -> np.ndarray | None:
    """The places of a text's n words, of which a tenth of the texts, by their ids, repeat a part from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import digests

    return digests(table(spark, sf_dir, "documents"), order=planted_order)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_token_output, op3_exact_topk, op4_sharding, op5_near_duplicates, op6_nearest, op7_html, op8_bpe, op9_pii, op10_quality, op11_runs, op12_token_counts)
}
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS g
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.g AS DOUBLE[]), CAST(c.g AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.g) = len(c.g)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
