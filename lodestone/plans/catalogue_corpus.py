"""Corpus upkeep queries: identities, windows, sync, generations, runs, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import chunking, search, sync
from .catalogue import Tables, query
from .engine import word_offsets

CAPACITY, OVERLAP = 100, 20
TOKENS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}\p{Co}]+')"


@query("""
SELECT doc_id, sha256(source) AS root_id, sha256(sha256(source) || chr(0) || CAST(doc_id AS VARCHAR)) AS document_id, sha256(text) AS text_hash FROM documents
""")
def doc_ids(t):
    root = ids.root_id("source")
    return t.documents.select("doc_id", root.alias("root_id"), ids.document_id(root, F.col("doc_id").cast("string")).alias("document_id"), ids.sha256_text("text").alias("text_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS documents, min(doc_id) AS first FROM documents GROUP BY 1")
def content_hash(t):
    return t.documents.groupBy(ids.sha256_text("text").alias("content_hash")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


WINDOWS = f"""
n AS (SELECT doc_id, len({TOKENS}) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= {CAPACITY} THEN 1 ELSE CAST(ceil((n - {CAPACITY}) / {CAPACITY - OVERLAP}.0) AS BIGINT) + 1 END)) AS ordinal FROM n)"""


def _windows(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.size(text.tokens("text")).alias("n"))
    return chunking.windows(rows, "n", CAPACITY, OVERLAP)


@query(f"WITH {WINDOWS} SELECT doc_id, ordinal, ordinal * {CAPACITY - OVERLAP} AS token_start, least(ordinal * {CAPACITY - OVERLAP} + {CAPACITY}, n) AS token_end FROM w")
def token_windows(t):
    return _windows(t).select("doc_id", "ordinal", "token_start", "token_end")


@query(f"""
WITH {WINDOWS}
SELECT doc_id, ordinal, sha256(sha256(CAST(doc_id AS VARCHAR)) || chr(0) || 'r1' || chr(0) || CAST(ordinal AS VARCHAR) || chr(0) || text) AS chunk_id FROM w JOIN documents USING (doc_id)
""")
def chunk_ids(t):
    doc = ids.sha256_text(F.col("doc_id").cast("string"))
    return _windows(t).select("doc_id", "ordinal", ids.chunk_id(doc, F.lit("r1"), "ordinal", "text").alias("chunk_id"))


@query(r"""
WITH words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x09-\x0d ]+') AS ws, regexp_extract_all(text, '[\x09-\x0d ]*[^\x09-\x0d ]+') AS ps FROM documents),
w AS (SELECT *, len(ws) AS n, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 40 THEN 1 ELSE CAST(ceil((len(ws) - 40) / 32.0) AS BIGINT) + 1 END)) AS ordinal FROM words),
p AS (SELECT *, ordinal * 32 AS a, least(ordinal * 32 + 40, n) AS b FROM w)
SELECT doc_id, ordinal, a AS token_start, b AS token_end,
  CAST(CASE WHEN ordinal = 0 THEN 0 ELSE octet_length(encode(array_to_string(ps[1:a + 1], ''))) - octet_length(encode(ws[a + 1])) END AS BIGINT) AS byte_start,
  CAST(CASE WHEN b = n THEN octet_length(encode(text)) ELSE octet_length(encode(array_to_string(ps[1:b + 1], ''))) - octet_length(encode(ws[b + 1])) END AS BIGINT) AS byte_end,
  sha256(CASE WHEN ordinal = 0 THEN ps[1] ELSE ws[a + 1] END || array_to_string(ps[a + 2:b], '') || CASE WHEN b = n THEN regexp_extract(text, '[\x09-\x0d ]*$') ELSE left(ps[b + 1], length(ps[b + 1]) - length(ws[b + 1])) END) AS chunk_hash
FROM p
""")
def text_chunks(t):
    rows = chunking.with_offsets(t.documents.select("doc_id", "text"), word_offsets)
    out = chunking.chunks(rows, 40, 8)
    return out.select("doc_id", "ordinal", "token_start", "token_end", "byte_start", "byte_end", ids.sha256_text("chunk_text").alias("chunk_hash"))


OLD = "old AS (SELECT doc_id AS document_id, source AS source_root_id, sha256(CASE WHEN doc_id % 50 = 1 THEN text || '!' ELSE text END) AS content_hash, CAST(NULL AS VARCHAR) AS recipe FROM documents WHERE doc_id % 40 <> 3)"
NEW = "new AS (SELECT doc_id AS document_id, source AS source_root_id, sha256(text) AS content_hash, CASE WHEN doc_id % 70 = 2 THEN 'r2' END AS recipe FROM documents WHERE doc_id % 30 <> 4)"


def _old(t: Tables) -> DataFrame:
    content = F.when(F.col("doc_id") % 50 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return t.documents.filter("doc_id % 40 <> 3").select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_root_id"), ids.sha256_text(content).alias("content_hash"), F.lit(None).cast("string").alias("recipe"))


def _new(t: Tables) -> DataFrame:
    recipe = F.when(F.col("doc_id") % 70 == 2, "r2")
    return t.documents.filter("doc_id % 30 <> 4").select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_root_id"), ids.sha256_text("text").alias("content_hash"), recipe.alias("recipe"))


def _state(t: Tables) -> DataFrame:
    return sync.outcomes(_old(t), _new(t), ["content_hash", "recipe"])


STATE = f"""{OLD}, {NEW},
state AS (SELECT n.*, CASE WHEN o.document_id IS NULL THEN 'new' WHEN n.content_hash IS NOT DISTINCT FROM o.content_hash AND n.recipe IS NOT DISTINCT FROM o.recipe THEN 'unchanged' ELSE 'changed' END AS outcome FROM new n LEFT JOIN old o USING (document_id)),
gone AS (SELECT o.* FROM old o WHERE source_root_id = 'src4' AND document_id NOT IN (SELECT document_id FROM new))"""


@query(f"WITH {STATE} SELECT document_id, outcome FROM state")
def sync_outcomes(t):
    return _state(t).select("document_id", "outcome")


@query(f"WITH {STATE} SELECT document_id, content_hash FROM state WHERE outcome = 'unchanged'")
def sync_unchanged(t):
    return _state(t).filter("outcome = 'unchanged'").select("document_id", "content_hash")


@query(f"WITH {STATE} SELECT document_id, content_hash, recipe FROM state WHERE outcome <> 'unchanged'")
def sync_changed(t):
    return _state(t).filter("outcome <> 'unchanged'").select("document_id", "content_hash", "recipe")


@query(f"WITH {STATE} SELECT document_id FROM gone")
def sync_pruned(t):
    return sync.pruned(_old(t), _new(t), "src4").select("document_id")


@query(f"WITH {STATE} SELECT count(*) AS pruned FROM gone WHERE false")
def sync_incomplete_prunes_nothing(t):
    return sync.pruned(_old(t), _new(t), "src4", complete=False).agg(F.count("*").alias("pruned"))


@query(f"""
WITH {STATE}, changed AS (SELECT document_id, source_root_id, content_hash, recipe FROM state WHERE outcome <> 'unchanged')
SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM changed) AND document_id NOT IN (SELECT document_id FROM gone) UNION ALL SELECT * FROM changed
""")
def replace_document_snapshot(t):
    changed = _state(t).filter("outcome <> 'unchanged'").drop("outcome")
    return sync.replaced(_old(t), changed, sync.pruned(_old(t), _new(t), "src4"))


@query(f"WITH {STATE} SELECT source_root_id, count(*) FILTER (outcome <> 'unchanged') AS documents, count(*) FILTER (outcome = 'unchanged') AS unchanged FROM state GROUP BY 1")
def ingest_counters(t):
    return _state(t).groupBy("source_root_id").agg(F.count_if(F.col("outcome") != "unchanged").alias("documents"), F.count_if(F.col("outcome") == "unchanged").alias("unchanged"))


@query("""
WITH a AS (SELECT DISTINCT source AS id, 'old' AS metadata, 'r1' AS run FROM documents WHERE source < 'src5'), b AS (SELECT DISTINCT source AS id, 'new' AS metadata, CASE WHEN source > 'src15' THEN 'r2' END AS run FROM documents WHERE source > 'src12')
SELECT coalesce(a.id, b.id) AS id, coalesce(b.metadata, a.metadata) AS metadata, coalesce(b.run, a.run) AS run FROM a FULL OUTER JOIN b ON a.id = b.id
""")
def root_upsert(t):
    names = t.documents.select(F.col("source").alias("id")).distinct()
    old = names.filter("id < 'src5'").select("id", F.lit("old").alias("metadata"), F.lit("r1").alias("run"))
    new = names.filter("id > 'src12'").select("id", F.lit("new").alias("metadata"), F.when(F.col("id") > "src15", "r2").alias("run"))
    return sync.upsert_roots(old, new)


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def active_coverage_missing(t):
    return sync.missing_vectors(t.documents.select(F.col("doc_id").alias("chunk_id")), _vectors(t, 1), 1)


def _vectors(t: Tables, generation: int) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.lit(generation).cast("long").alias("generation_id"), "label")


@query("""
WITH chunks AS (SELECT vec_id AS chunk_id, label FROM embeddings), have AS (SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 3 = 0)
SELECT chunk_id, CAST(2 AS BIGINT) AS generation_id, label, chunk_id NOT IN (SELECT chunk_id FROM have) AS made FROM chunks
""")
def generation_rebuild(t):
    have = _vectors(t, 2).filter("chunk_id % 3 = 0")
    missing = sync.missing_vectors(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label"), have, 2)
    made = missing.select("chunk_id", F.lit(2).cast("long").alias("generation_id"), "label", F.lit(True).alias("made"))
    return have.withColumn("made", F.lit(False)).unionByName(made)


@query("""
WITH g AS (SELECT 1 AS generation, count(*) AS vectors, count(*) FILTER (vec_id NOT IN (SELECT doc_id FROM documents)) AS dangling FROM embeddings),
m AS (SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))
SELECT CAST(generation AS INTEGER) AS generation, vectors, dangling, missing, missing = 0 AS may_activate FROM g, m
""")
def generation_activate(t):
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"))
    missing = sync.missing_vectors(docs, _vectors(t, 1), 1).agg(F.count("*").alias("missing"))
    dangling = _vectors(t, 1).join(docs, "chunk_id", "left_anti").agg(F.count("*").alias("dangling"))
    total = _vectors(t, 1).agg(F.count("*").alias("vectors"))
    one = total.join(F.broadcast(dangling)).join(F.broadcast(missing))  # one row each
    return one.select(F.lit(1).alias("generation"), "vectors", "dangling", "missing", (F.col("missing") == 0).alias("may_activate"))


@query("""
SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'roots', count(DISTINCT source) FROM documents UNION ALL SELECT 'failures', count(*) FROM events WHERE event_type = 'error'
""")
def status_counts(t):
    def count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")

    parts = [count("documents", t.documents), count("embeddings", t.embeddings), count("roots", t.documents.select("source").distinct()), count("failures", t.events.filter("event_type = 'error'"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT event_id AS id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def run_retention(t):
    runs = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), "user_id")
    return sync.latest_runs(runs).select("id", "user_id")


@query("SELECT user_id AS run_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def failure_cap(t):
    return sync.capped_failures(t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id")), 5)


@query("""
WITH m AS (SELECT event_id, CASE CAST(event_id % 7 AS INTEGER) WHEN 0 THEN 'size_limit: 70 MiB' WHEN 1 THEN 'open: unsafe_symlink' WHEN 2 THEN 'binary_input or size_limit' WHEN 3 THEN 'private_network 10.0.0.1' WHEN 4 THEN 'unsupported format' WHEN 5 THEN 'changed_while_reading' ELSE props END AS msg FROM events)
SELECT CASE WHEN contains(msg, 'size_limit') THEN 'size_limit' WHEN contains(msg, 'private_network') THEN 'private_network' WHEN contains(msg, 'missing_extractor') THEN 'missing_extractor' WHEN contains(msg, 'extractor_timeout') THEN 'extractor_timeout'
  WHEN contains(msg, 'binary_input') THEN 'binary_input' WHEN contains(msg, 'unsupported') THEN 'unsupported' WHEN contains(msg, 'unsafe_symlink') THEN 'unsafe_symlink' WHEN contains(msg, 'changed_while_reading') THEN 'changed_while_reading' ELSE 'input_failed' END AS code, count(*) AS n
FROM m GROUP BY 1
""")
def error_codes(t):
    texts = ["size_limit: 70 MiB", "open: unsafe_symlink", "binary_input or size_limit", "private_network 10.0.0.1", "unsupported format", "changed_while_reading"]
    msg = F.col("props")
    for i, x in enumerate(texts):
        msg = F.when(F.col("event_id") % 7 == i, x).otherwise(msg)
    return t.events.groupBy(sync.error_code(msg).alias("code")).agg(F.count("*").alias("n"))


SEGMENTS = """
c AS (SELECT conv_id, turn, octet_length(encode(text)) AS size, sum(octet_length(encode(text)) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - octet_length(encode(text)) - 2 AS byte_start FROM conversations)"""


def _cells(t: Tables) -> DataFrame:
    """Turns as the cells of a notebook: two line breaks after each, ranges without them."""
    turns = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    start = F.aggregate("x", F.array(F.lit(0)), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + F.octet_length(c["text"]) + 2)))
    cells = F.zip_with("x", F.slice(start, 1, F.size("x")), lambda c, a: F.struct(c["turn"].alias("cell"), a.cast("long").alias("byte_start"), (a + F.octet_length(c["text"])).cast("long").alias("byte_end")))
    joined = F.concat(F.array_join(F.transform("x", lambda c: c["text"]), "\n\n"), F.lit("\n\n"))
    return turns.select("conv_id", joined.alias("text"), cells.alias("cells"))


@query("SELECT conv_id, sha256(string_agg(text || chr(10) || chr(10), '' ORDER BY turn)) AS text_hash, CAST(count(*) AS INTEGER) AS cells, CAST(sum(octet_length(encode(text)) + 2) AS BIGINT) AS bytes FROM conversations GROUP BY 1")
def notebook_like_concat(t):
    return _cells(t).select("conv_id", ids.sha256_text("text").alias("text_hash"), F.size("cells").alias("cells"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"WITH {SEGMENTS} SELECT conv_id, turn AS cell, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_start + size AS BIGINT) AS byte_end FROM c WHERE byte_start < 300 AND byte_start + size > 100")
def overlap_locations(t):
    hits = search.overlapping(F.col("cells"), F.lit(100), F.lit(300))
    return _cells(t).select("conv_id", F.explode(hits).alias("x")).select("conv_id", "x.*")


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+')), '^(http://[^/]*):80$', '\1'), '^(https://[^/]*):443$', '\1') ||
  CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '\?[^#]*') AS url FROM pages
""")
def url_normalize(t):
    head = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+", 0))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return t.pages.select("page_id", F.concat(head, F.when(path == "", "/").otherwise(path), F.regexp_extract("url", r"\?[^#]*", 0)).alias("url"))


@query("""
WITH c AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '[\\x01-\\x08\\x0B\\x0E-\\x1F\\x7F]', '', 'g')) AS odd FROM documents)
SELECT doc_id, odd * 100 > n AS is_binary FROM c
""")
def binary_sniff(t):
    odd = F.length("text") - F.length(F.regexp_replace("text", r"[\x01-\x08\x0B\x0E-\x1F\x7F]", ""))
    return t.documents.select("doc_id", (odd * 100 > F.length("text")).alias("is_binary"))


@query()
def html_extract(t):
    """Main regions of pages as the ingest path extracts them; not to be said in SQL, tested on fixtures."""
    from ..sources.extractors import extracted

    items = t.pages.select(
        F.lit("pages").alias("source_root_id"), F.col("url").alias("uri"), F.lit(None).cast("string").alias("path"), F.col("html").cast("binary").alias("content"), F.lit("html").alias("extension"), F.lit(None).cast("string").alias("modified_ns"), F.lit("{}").alias("metadata")
    )
    return extracted(items).select("uri", "text", "media_type", "extractor", "metadata", "error")


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) + 0.0 AS total, max(value) AS longest FROM events GROUP BY 1")
def stage_counters(t):
    return t.events.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), (F.round(F.sum("value"), 4) + 0.0).alias("total"), F.max("value").alias("longest"))


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) <= 3 AS shortest FROM documents")
def length_order(t):
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy("n_chars", "doc_id")
    return t.documents.select("doc_id", "lang", (F.row_number().over(order) <= 3).alias("shortest"))


@query("""
SELECT item_id, item_id % 5 <> 0 AND NOT (item_id % 5 = 1) AND length(trim(text)) > 0 AS valid FROM benchmark
""")
def request_stream(t):
    """Benchmark texts as request lines, some with a wrong version or limit."""
    from ..streaming.serve import valid_frames

    v = F.when(F.col("item_id") % 5 == 0, 2).otherwise(1)
    limit = F.when(F.col("item_id") % 5 == 1, 0).otherwise(10)
    line = F.to_json(F.struct(v.alias("v"), F.col("item_id").cast("string").alias("id"), F.lit("search").alias("op"), F.col("text").alias("query"), limit.alias("limit")))
    out = valid_frames(t.benchmark.select(line.alias("value")))
    return out.select(F.col("id").cast("long").alias("item_id"), "valid")
