"""Search queries over the sample tables: a document is a chunk, its source the root, its language the media type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import dense, lexical, search
from .catalogue import Tables, query, r6
from .textindex import index_of

COS = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"
TOKENS = r"regexp_extract_all(lower(strip_accents({c})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
#: Words that the lexical queries look for; words of the sample texts and an odd one.
WORDS = "the stupid die"


def chunks(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_root_id"), F.col("lang").alias("media_type"))


def vectors_of(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def roots(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct().select(F.col("source").alias("id"), F.concat(F.lit("file:///"), "source").alias("identity"))


def visible(scored: DataFrame, t: Tables) -> DataFrame:
    """Chunks without a vector in the active generation are not found by any mode."""
    return scored.join(vectors_of(t).select("chunk_id"), "chunk_id", "left_semi")


@query(f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)
SELECT vec_id AS chunk_id, round(1 - {COS.format(a='e.embedding', b='q.v')}, 6) + 0.0 AS distance
FROM embeddings e, q ORDER BY 1 - {COS.format(a='e.embedding', b='q.v')}, vec_id LIMIT 10
""")
def knn_exact(t):
    return dense.knn_of_row(vectors_of(t), 7, 10, "chunk_id").select("chunk_id", r6(F.col("distance")).alias("distance"))


FILTERED = f"""
SELECT d.doc_id AS chunk_id, 1 - {COS.format(a='e.embedding', b='q.v')} AS distance
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) q
WHERE d.source = 'src0' AND d.lang = 'en'
"""


def _in_scope(t: Tables) -> DataFrame:
    scope = search.scoped(chunks(t), roots(t), root="src0", media_type="en").select("chunk_id")
    return vectors_of(t).join(scope, "chunk_id", "left_semi")


def _near(t: Tables, rows: DataFrame, k: int) -> DataFrame:
    """Rows nearest to the stored query vector, which need not be among them."""
    return dense.knn_of_row(rows, 7, k, "chunk_id", stored=vectors_of(t))


@query(f"SELECT chunk_id, round(distance, 6) + 0.0 AS distance FROM ({FILTERED}) ORDER BY distance, chunk_id LIMIT 10")
def knn_filtered(t):
    return _near(t, _in_scope(t), 10).select("chunk_id", r6(F.col("distance")).alias("distance"))


@query(f"""
WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10
""")
def knn_all_queries_top10(t):
    asked = t.embeddings.filter("vec_id % 20 = 0")
    return dense.nearest(asked, t.embeddings, 10, "vec_id", "vec_id", digits=9).select("query_id", "id", "rank", r6(F.col("score")).alias("score"))


def _scan_sql(phrases: list[list[str]], visible_only: bool = True, where: str = "true") -> str:
    """BM25 over all documents by the scan form, as SQL; phrases are matched in the tokens joined by single spaces."""
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    tf = ", ".join(
        f"len(list_filter(t, lambda x: x = '{p[0]}'))::BIGINT AS tf{i}" if len(p) == 1
        else "len(list_filter(range(1, greatest(len(t) - " + str(len(p) - 2) + ", 1)), lambda i: " + " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p)) + f"))::BIGINT AS tf{i}"
        for i, p in enumerate(distinct)
    )
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(distinct)))
    parts = " + ".join(
        f"{phrases.count(p)} * (CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i, p in enumerate(distinct)
    )
    some = " OR ".join(f"tf{i} > 0" for i in range(len(distinct)))
    seen = "AND doc_id IN (SELECT vec_id FROM embeddings)" if visible_only else ""
    return f"""
tok AS (SELECT doc_id, source, lang, {TOKENS.format(c='text')} AS t FROM documents),
cnt AS (SELECT doc_id, source, lang, len(t) AS dl, {tf} FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM cnt),
bm AS (SELECT doc_id AS chunk_id, -({parts}) AS score FROM cnt, st WHERE ({some}) {seen} AND {where})
"""


def _top_sql(phrases, k=10, **more) -> str:
    return f"WITH {_scan_sql(phrases, **more)} SELECT chunk_id, round(score, 6) + 0.0 AS score FROM bm ORDER BY round(score, 9), chunk_id LIMIT {k}"


def _lexical(t: Tables, phrases, k=10) -> DataFrame:
    scored = visible(index_of(chunks(t)).bm25(phrases), t).withColumn("score", F.round("score", 9))
    return lexical.top(scored, k).select("chunk_id", r6(F.col("score")).alias("score"))


@query(_top_sql([["stupid"]]))
def bm25_single(t):
    return _lexical(t, lexical.query_phrases("stupid"))


@query(_top_sql([[w] for w in WORDS.split()]))
def bm25_or(t):
    return _lexical(t, lexical.query_phrases(WORDS))


@query(_top_sql([["of", "the"], ["in", "the"]]))
def bm25_phrase(t):
    return _lexical(t, lexical.query_phrases("of-the in/the"))


@query(_top_sql([["stupid"], ["stupid"], ["trash"]]))
def bm25_repeated_term(t):
    return _lexical(t, lexical.query_phrases("Stupid stupid, TRASH ..."))


@query(f"""
WITH tok AS (SELECT doc_id, {TOKENS.format(c='text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.format(c='text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (
  SELECT q.item_id AS query_id, p.doc_id AS id,
    -sum(times * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN post p USING (term) JOIN dfs USING (term), st GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank FROM sc)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 5
""")
def bm25_benchmark_queries(t):
    out = lexical.bm25_of_queries(chunks(t), t.benchmark, "item_id", "text", 5)
    return out.select("query_id", "id", "rank", r6(F.col("score")).alias("score"))


@query(f"""
WITH tok AS (SELECT doc_id, {TOKENS.format(c='text')} AS t FROM documents),
pos AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM tok)
SELECT term, doc_id AS chunk_id, CAST(dl AS INTEGER) AS dl, CAST(count(*) AS INTEGER) AS tf, array_to_string(list(p ORDER BY p), ',') AS positions
FROM pos GROUP BY 1, 2, 3
""")
def postings_index(t):
    return lexical.postings(chunks(t)).select("term", "chunk_id", "dl", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(f"WITH {_scan_sql([['of', 'the']], visible_only=False)} SELECT doc_id AS chunk_id, CAST(dl AS INTEGER) AS dl, tf0 AS tf FROM cnt WHERE tf0 > 0")
def phrase_from_index(t):
    return lexical.phrase_postings(index_of(chunks(t)).postings(), ["of", "the"])


DEPTH = search.candidate_limit("hybrid", 10)


def _hybrid_sql(dense_sql: str, where: str = "true") -> str:
    return f"""
WITH {_scan_sql([[w] for w in WORDS.split()], where=where)},
dense AS (SELECT chunk_id, distance, row_number() OVER (ORDER BY round(distance, 9), chunk_id) AS rk FROM ({dense_sql}) QUALIFY rk <= {DEPTH}),
lex AS (SELECT chunk_id, score, row_number() OVER (ORDER BY round(score, 9), chunk_id) AS rk FROM bm QUALIFY rk <= {DEPTH}),
fused AS (
  SELECT coalesce(d.chunk_id, l.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + d.rk), 0) + coalesce(1.0::DOUBLE / (60 + l.rk), 0) AS fusion_score, d.distance, l.score AS bm25
  FROM dense d FULL OUTER JOIN lex l ON d.chunk_id = l.chunk_id
)
SELECT CAST(row_number() OVER (ORDER BY round(fusion_score, 12) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(fusion_score, 9) AS fusion_score, round(distance, 6) + 0.0 AS distance, round(bm25, 6) + 0.0 AS bm25
FROM fused QUALIFY rank <= 10
"""


ALL_DENSE = f"SELECT vec_id AS chunk_id, 1 - {COS.format(a='e.embedding', b='q.v')} AS distance FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) q"


def _hybrid(t: Tables, rows: DataFrame, scope: DataFrame) -> DataFrame:
    near = _near(t, rows, DEPTH).withColumn("distance", F.round("distance", 9))
    scored = index_of(chunks(t)).bm25(lexical.query_phrases(WORDS)).join(scope, "chunk_id", "left_semi")
    best = lexical.top(visible(scored, t).withColumn("score", F.round("score", 9)), DEPTH)
    out = search.fuse(near, best, 10)
    return out.select("rank", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"), r6(F.col("distance")).alias("distance"), r6(F.col("bm25")).alias("bm25"))


@query(_hybrid_sql(ALL_DENSE))
def hybrid_rrf(t):
    live = chunks(t).select("chunk_id")
    return _hybrid(t, vectors_of(t).join(live, "chunk_id", "left_semi"), live)


@query(_hybrid_sql(FILTERED, "source = 'src0' AND lang = 'en'"))
def hybrid_rrf_filtered(t):
    scope = search.scoped(chunks(t), roots(t), root="file:///src0", media_type="en").select("chunk_id")
    return _hybrid(t, _in_scope(t), scope)


@query(f"""
WITH top AS (SELECT chunk_id, round(distance, 6) + 0.0 AS distance FROM ({FILTERED}) ORDER BY distance, chunk_id LIMIT 10),
r AS (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM top)
SELECT CAST(rank AS INTEGER) AS rank, chunk_id, distance, d.source AS source_root_id, d.lang AS media_type, d.text,
  CAST(sum(octet_length(encode(d.text))) OVER (ORDER BY rank) AS BIGINT) AS bytes, sum(octet_length(encode(d.text))) OVER (ORDER BY rank) <= 20000 AS fits
FROM r JOIN documents d ON d.doc_id = r.chunk_id
""")
def hydrate_topk(t):
    best = _near(t, _in_scope(t), 10).withColumn("distance", r6(F.col("distance")))
    docs = t.documents.select("doc_id", F.col("source").alias("source_root_id"), F.col("lang").alias("media_type"))
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    full = search.hydrate(search.ranked(best, "distance"), texts, docs, doc_col="doc_id").drop("doc_id")
    return search.within_budget(full, 20_000)


@query("""
SELECT count(*) > 0 AS has_candidates FROM (SELECT 1 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.source = 'src3' AND d.lang = 'de' LIMIT 1)
""")
def scope_exists(t):
    return search.has_candidates(search.scoped(chunks(t), roots(t), "src3", "de"), vectors_of(t))


@query("SELECT false AS has_candidates")
def scope_unknown_root(t):
    return search.has_candidates(search.scoped(chunks(t), roots(t), "no such root"), vectors_of(t))


@query("""
WITH r AS (SELECT DISTINCT source AS id, 'file:///' || source AS identity FROM documents UNION ALL SELECT 'file:///src1' AS id, 'other' AS identity)
SELECT id AS root_id FROM r WHERE id = 'file:///src1' OR identity = 'file:///src1' ORDER BY id = 'file:///src1' DESC, identity = 'file:///src1' DESC LIMIT 1
""")
def root_resolution(t):
    more = t.spark.createDataFrame([("file:///src1", "other")], "id string, identity string")
    return search.resolve_root(roots(t).unionByName(more), "file:///src1")


@query("SELECT source AS identity, count(*) AS documents FROM documents GROUP BY source ORDER BY source")
def source_list(t):
    return t.documents.groupBy(F.col("source").alias("identity")).agg(F.count("*").alias("documents")).orderBy("identity")


@query("""
SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
  AND abs(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) - 1) < 0.001 AS valid FROM embeddings
""")
def vector_validate(t):
    return t.embeddings.select("vec_id", vectors.is_unit("embedding", 64).alias("valid"))


@query("""
SELECT vec_id, round(list_sum(list_transform(list_zip(v, range(1, 65)), lambda p: CAST(CAST(CAST(p[1] AS DOUBLE) / n AS FLOAT) AS DOUBLE) * p[2])), 4) + 0.0 AS fingerprint
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) AS v, sqrt(list_inner_product(CAST(list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) AS DOUBLE[]), CAST(list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) AS DOUBLE[]))) AS n FROM embeddings)
""")
def vector_normalize(t):
    tripled = F.transform("embedding", lambda x: (x * F.lit(3)).cast("float"))
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return t.embeddings.select("vec_id", (F.round(vectors.dot(vectors.normalize(tripled), weights), 4) + 0.0).alias("fingerprint"))


@query("""
SELECT vec_id, CAST(16 AS INTEGER) AS dimensions, round(sqrt(list_inner_product(w, w)), 5) AS norm, round(w[1], 5) + 0.0 AS first
FROM (SELECT vec_id, list_transform(p, lambda x: CAST(CAST(x / sqrt(list_inner_product(p, p)) AS FLOAT) AS DOUBLE)) AS w FROM (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS p FROM embeddings))
""")
def vector_project(t):
    rows = t.embeddings.select("vec_id", vectors.project("embedding", 16).alias("w"))
    return rows.select("vec_id", F.size("w").alias("dimensions"), F.round(vectors.norm("w"), 5).alias("norm"), (F.round(F.col("w")[0].cast("double"), 5) + 0.0).alias("first"))


@query(f"SELECT doc_id, CAST(len({TOKENS.format(c='text')}) AS INTEGER) AS tokens FROM documents")
def tokens_per_doc(t):
    return t.documents.select("doc_id", F.size(text.tokens("text")).alias("tokens"))
