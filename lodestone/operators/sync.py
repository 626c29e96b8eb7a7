"""Incremental sync as set operations between a stored snapshot and what a scan found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of failures in the order they are looked for, and the code of all others.
ERROR_CODES = ("size_limit", "private_network", "missing_extractor", "extractor_timeout", "binary_input", "unsupported", "unsafe_symlink", "changed_while_reading")
OTHER_ERROR = "input_failed"


def error_code(message: Column) -> Column:
    out = F.lit(OTHER_ERROR)
    for code in reversed(ERROR_CODES):
        out = F.when(F.contains(message, F.lit(code)), F.lit(code)).otherwise(out)
    return out


def outcomes(stored: DataFrame, found: DataFrame, same: list[str], key: str = "document_id") -> DataFrame:
    """``found`` with ``outcome``: new, changed or unchanged, by null-safe equality of the ``same`` columns."""
    old = stored.select(key, *[F.col(c).alias(f"_old_{c}") for c in same], F.lit(True).alias("_known"))
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    state = F.when(F.col("_known").isNull(), "new").when(alike, "unchanged").otherwise("changed")
    return found.join(old, key, "left").withColumn("outcome", state).drop("_known", *[f"_old_{c}" for c in same])


def pruned(stored: DataFrame, found: DataFrame, root: str, key: str = "document_id", complete: bool = True) -> DataFrame:
    """Stored rows of one root that a complete scan did not find; an incomplete scan prunes nothing."""
    mine = stored.filter(F.col("source_root_id") == root)
    return mine.join(found.select(key), key, "left_anti") if complete else mine.limit(0)


def replaced(stored: DataFrame, changes: DataFrame, removed: DataFrame, key: str = "document_id") -> DataFrame:
    """The next snapshot: stored rows but the changed and removed ones, and the changed ones as they are now."""
    gone = changes.select(key).unionByName(removed.select(key)).distinct()
    return stored.join(gone, key, "left_anti").unionByName(changes)


def upsert_roots(roots: DataFrame, seen: DataFrame) -> DataFrame:
    """Roots by identity: metadata and the attempted run come from what was seen, a run that succeeded stays."""
    merged = roots.alias("a").join(seen.alias("b"), "id", "full_outer")
    pick = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in roots.columns if c != "id"]
    return merged.select("id", *pick)


def latest_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    """The newest runs, by start and then by id."""
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def capped_failures(failures: DataFrame, n: int = 1000) -> DataFrame:
    """The first failures of each run, in order."""
    return failures.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy("id"))).filter(F.col("_r") <= n).drop("_r")


def missing_vectors(chunks: DataFrame, embeddings: DataFrame, generation: int, id_col: str = "chunk_id") -> DataFrame:
    """Chunks that a generation has no vector of yet."""
    return chunks.join(embeddings.filter(F.col("generation_id") == generation).select(id_col), id_col, "left_anti")
