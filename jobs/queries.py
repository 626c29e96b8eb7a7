"""The jobs as registered queries: each runs twice into one new folder, over whole tables, and returns its output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import shared
from lodestone.plans.catalogue_search import TOKENS

from . import evaluate_retrieval, index_documents


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings that count after both runs; the second run finds nothing new."""
    at, config, documents = shared.new_folder(spark, "job1"), index_documents.configuration(), f"{sf_dir}/documents.parquet"
    for _ in range(2):
        index_documents.run(spark, documents, f"{at}/output", f"{at}/checkpoint", config)
    rows = index_documents.live(spark, f"{at}/output", index_documents.schemas_of(spark.read.parquet(documents), config))
    return rows.select("term", "doc_id", "dl", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def job2_evaluate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listed documents with the measures of their queries."""
    at, config = shared.new_folder(spark, "job2"), evaluate_retrieval.configuration()
    for _ in range(2):
        evaluate_retrieval.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{at}/output", config)
    ranking, metrics = (spark.read.parquet(f"{at}/output/{name}") for name in ("ranking", "metrics"))
    return ranking.join(metrics.withColumn("judged", F.col("judged").cast("boolean")), "query_id")


QUERIES = {f.__name__: f for f in (job1_index_documents, job2_evaluate_retrieval)}

ONE_EACH = "one AS (SELECT doc_id, max_by(coalesce(text, ''), sha256(coalesce(text, ''))) AS text, max_by(source, sha256(coalesce(text, ''))) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"
ORACLE_SQL = {
    "job1_index_documents": f"""
WITH {ONE_EACH}, tok AS (SELECT doc_id, {TOKENS.format(c='text')} AS t FROM one),
pos AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM tok)
SELECT term, doc_id, CAST(dl AS INTEGER) AS dl, CAST(count(*) AS INTEGER) AS tf, array_to_string(list(p ORDER BY p), ',') AS positions
FROM pos GROUP BY 1, 2, 3
""",
    "job2_evaluate_retrieval": f"""
WITH {ONE_EACH}, tok AS (SELECT doc_id, source, {TOKENS.format(c='text')} AS t FROM one),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT item_id, {TOKENS.format(c='text')} AS tq FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(tq) AS term FROM asked) GROUP BY ALL),
sc AS (
  SELECT q.item_id AS query_id, p.doc_id AS id,
    -sum(times * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN post p USING (term) JOIN dfs USING (term), st GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank FROM sc QUALIFY rank <= 20),
j AS (
  SELECT r.*, source, contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(tq, ' ') || ' ') AS relevant
  FROM r JOIN tok ON doc_id = id JOIN asked ON item_id = query_id
), neg AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS negative FROM j WHERE NOT relevant QUALIFY negative <= 3),
rel AS (SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place FROM j WHERE relevant),
met AS (
  SELECT query_id, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 10), 0), 6) AS mrr,
    round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / sum(1 / log2(place + 1)) FILTER (place <= 10), 6) AS ndcg
  FROM rel GROUP BY 1
), per AS (
  SELECT j.query_id, count(*) FILTER (relevant) AS hits, CAST(3 - (SELECT count(*) FROM neg WHERE neg.query_id = j.query_id) AS BIGINT) AS shortfall FROM j GROUP BY 1
)
SELECT j.query_id, j.id, CAST(j.rank AS INTEGER) AS rank, round(j.score, 6) AS score, j.relevant, CAST(coalesce(neg.negative, 0) AS INTEGER) AS negative, j.source, per.hits, met.recall, met.mrr, met.ndcg, per.shortfall, per.hits > 0 AS judged
FROM j JOIN per USING (query_id) LEFT JOIN met USING (query_id) LEFT JOIN neg ON neg.query_id = j.query_id AND neg.id = j.id
""",
}
