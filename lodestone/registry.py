"""All queries of the core library by name, and the SQL that says the same."""

from __future__ import annotations

from .plans import catalogue_corpus, catalogue_quality, catalogue_search
from .plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue_corpus", "catalogue_quality", "catalogue_search"]
