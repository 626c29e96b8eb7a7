"""Scopes, fusion and hydration: what stands around the two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60
MODES = ("semantic", "lexical", "hybrid")
# The keys under which a document's metadata list ranges of its text.
RANGES = ("pages", "cells", "locations")
MOST_QUERY = 65_536
#: What of a result counts against a budget of bytes.
CHARGED = ("chunk_id", "document_id", "text", "uri", "source_root_id", "source", "media_type", "metadata", "source_metadata")


def candidate_limit(mode: str, limit: int) -> int:
    """Depth of each branch: hybrid looks at four times the limit, between 100 and 4096."""
    return min(max(4 * limit, 100), 4096) if mode == "hybrid" else limit


def validate_request(query: str, mode: str = "semantic", limit: int = 10, root: str | None = None, media_type: str | None = None) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    for name, value in (("root", root), ("media_type", media_type)):
        if value is not None and (not value.strip() or "\0" in value):
            raise ValueError(f"{name} must be non-blank and without NUL")
    if not query.strip() or "\0" in query or len(query.encode()) > MOST_QUERY:
        raise ValueError("invalid query text")


def resolve_root(roots: DataFrame, wanted: str) -> DataFrame:
    """The one root that a filter names, as ``root_id``: by id first, then by identity; no row if there is none."""
    hit = roots.filter((F.col("id") == wanted) | (F.col("identity") == wanted))
    return hit.orderBy(F.desc(F.col("id") == wanted), F.desc(F.col("identity") == wanted)).limit(1).select(F.col("id").alias("root_id"))


def scoped(chunks: DataFrame, roots: DataFrame | None = None, root: str | None = None, media_type: str | None = None) -> DataFrame:
    """Rows of one root and media type. An unknown root leaves nothing, never everything."""
    out = chunks if media_type is None else chunks.filter(F.col("media_type") == media_type)
    if root is not None:
        out = out.join(F.broadcast(resolve_root(roots, root)), F.col("source_root_id") == F.col("root_id"), "left_semi")
    return out


def has_candidates(chunks: DataFrame, active: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: is there any chunk in scope with a vector in the active generation?"""
    return chunks.join(active.select(id_col), id_col, "left_semi").limit(1).agg((F.count("*") > 0).alias("has_candidates"))


def fuse(dense: DataFrame, lexical: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion of two candidate lists (id, distance) and (id, score), both better when lower.

    Ranks start at 1 in each list, ties by id; a list that lacks a row adds nothing to it, and its value stays null.
    The lists are candidates, bounded by their depth, so the single ranking task is small.
    """
    def ranked(rows: DataFrame, value: str) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(Window.orderBy(value, id_col)))

    a = ranked(dense, "distance").select(id_col, "_rank", "distance", F.lit(None).cast("double").alias("bm25"))
    b = ranked(lexical, "score").select(id_col, "_rank", F.lit(None).cast("double").alias("distance"), F.col("score").alias("bm25"))
    one = F.lit(1.0) / (F.lit(RRF_K) + F.col("_rank"))
    both = a.unionByName(b).groupBy(id_col).agg(F.sum(one).alias("fusion_score"), F.max("distance").alias("distance"), F.max("bm25").alias("bm25"))
    best = both.orderBy(F.desc("fusion_score"), id_col).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fusion_score"), id_col)))


def ranked(rows: DataFrame, value: str, id_col: str = "chunk_id") -> DataFrame:
    """A single list with its ranks from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(value, id_col)))


def hydrate(top: DataFrame, chunks: DataFrame, documents: DataFrame, id_col: str = "chunk_id", doc_col: str = "document_id") -> DataFrame:
    """Texts and document fields of a bounded list of results, joined after the cut."""
    return F.broadcast(top).join(chunks, id_col).join(documents, doc_col)


def within_budget(results: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """Running bytes of the results in rank order and whether the list still fits; a list that doesn't is an error, not a cut."""
    run = F.sum(F.octet_length(text_col)).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("bytes", run).withColumn("fits", F.col("bytes") <= budget)


def overlapping(ranges: Column, start: Column, end: Column) -> Column:
    """The half-open byte ranges of an array that overlap [start, end); touching is not overlapping."""
    return F.filter(ranges, lambda r: (r["byte_start"] < end) & (r["byte_end"] > start))


def located(metadata: Column, start: Column, end: Column) -> Column:
    """The ranges that a document's metadata (JSON) list, each as JSON, that overlap bytes [start, end) of its text.

    Pages come before cells, and these before other locations; what is no list, and ranges without both ends as whole numbers,
    are passed over.
    """
    listed = [F.coalesce(F.from_json(F.get_json_object(metadata, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in RANGES]

    def meets(r: Column) -> Column:
        low, high = (F.get_json_object(r, f"$.{k}").try_cast("long") for k in ("byte_start", "byte_end"))
        return (low >= 0) & (high >= 0) & (low < end) & (high > start)

    return F.filter(F.concat(*listed), meets)


def charged(results: DataFrame, budget: int | None, columns: tuple[str, ...] = CHARGED) -> DataFrame:
    """Results with ``bytes``, the running bytes of their columns in rank order; the first that passes ``budget`` fails the whole list."""
    each = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in columns), F.lit(0).cast("long"))
    run = results.withColumn("bytes", F.sum(each).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    if budget is None:
        return run
    return run.filter(F.assert_true(F.col("bytes") <= budget, "response_limit: narrow the query or lower the limit").isNull())
