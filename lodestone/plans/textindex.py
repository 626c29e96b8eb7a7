"""The text index of a table of texts, written once in the folder that all executors share and read by every later query.

The folder holds ``postings`` (term, id, dl, tf, positions), in folders by term, so that a query on some words reads
little else; ``blocks``, the same without positions, in blocks with bounds; and ``sums``, one row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import shared
from ..operators import lexical


class TextIndex:
    """A written index: ``rows`` texts with ``length`` tokens. The schemas are given, so that an index without postings can be read."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema, self.blocked = spark, folder, schema, False
        self.rows, self.length = spark.read.schema("rows long, length long").parquet(f"{folder}/sums").first()

    @classmethod
    def write(cls, texts: DataFrame, folder: str, id_col: str = "chunk_id", text_col: str = "text") -> "TextIndex":
        """Index (id, text) rows under a new folder. A null text has no tokens and counts as a row; ids must be unique."""
        spark = texts.sparkSession
        made, rows = lexical.postings(texts, id_col, text_col), texts.count()
        lexical.write_postings(made, f"{folder}/postings", id_col, texts=rows)
        schema = StructType([*made.schema.fields, StructField("part", IntegerType())])
        held = spark.read.schema(schema).parquet(f"{folder}/postings")
        held.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length")).select(F.lit(rows).alias("rows"), "length").write.parquet(f"{folder}/sums")
        return cls(spark, folder, schema)

    def postings(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/postings")

    def blocks(self) -> DataFrame:
        """Written when they are first asked for: queries on a few words read postings only."""
        if not self.blocked:
            made = lexical.blocks(self.postings(), self.rows, self.length, self.schema[1].name)
            made.write.mode("overwrite").parquet(f"{self.folder}/blocks")
            self.blocked = True
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def bm25(self, phrases: list[list[str]], id_col: str = "chunk_id") -> DataFrame:
        return lexical.bm25_indexed(self.postings(), self.rows, self.length, phrases, id_col)

    def bm25_many(self, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
        return lexical.bm25_many(self.blocks(), self.rows, queries, query_id, query_text, k)


_written: dict[tuple[str, str], TextIndex] = {}


def index_of(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> TextIndex:
    """The index of a table, from its files as they are now: written by the first query of an application, read by the others."""
    spark = texts.sparkSession
    files = []
    for name in sorted(texts.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append(f"{name} {found.getLen()} {found.getModificationTime()}")
    key = (spark.sparkContext.applicationId, hashlib.sha256("\n".join([id_col, text_col, texts._jdf.queryExecution().analyzed().canonicalized().toString(), *files]).encode()).hexdigest())
    if key not in _written:
        _written[key] = TextIndex.write(texts, shared.new_folder(spark, "textindex"), id_col, text_col)
    return _written[key]
