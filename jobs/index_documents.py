"""Incremental full-text index of a growing folder of documents.

A file stream takes the files that no earlier run has taken, batch by batch, and stops when there are none left; Spark's checkpoint
keeps the mark. Each batch is a segment of two partitioned Parquet tables:

  postings/segment=N   term, id, dl, positions, tf: words of the batch's new or changed documents, each file in order of terms
  documents/segment=N  id, text_sha256, dl and the kept columns: one row for each of these documents

A document's last segment holds what counts of it, see ``live``. A batch that runs again after a failure overwrites its own
segment and no other; its documents become visible last, so readers never meet half a segment.

    python -m jobs.index_documents --documents PATH --output PATH --checkpoint PATH [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.functions import text
from lodestone.operators import lexical

log = logging.getLogger("jobs.index_documents")
CONFIG = os.path.join(os.path.dirname(__file__), "index_documents.json")
#: Rows of a file whose choice is one string of bits (Spark's own number), and replaced documents that one broadcast may hold: some 30 MB.
BITS, MOST_VOID = 1 << 15, 1 << 18


def configuration(path: str | None = None) -> dict:
    with open(path or CONFIG, encoding="utf-8") as f:
        return json.load(f)


def chosen(rows: DataFrame, earlier: DataFrame, id_col: str) -> DataFrame:
    """Which of ``rows`` the index takes: (_path, _bits, _taken), a bit for each row of a stretch of BITS rows of a file.

    Of each id that is the row of the newest file, ties by the file's name, the text's digest and the row's number, unless the text
    is the one that ``earlier`` (id, segment, text_sha256) has last. Rows without an id are left out. No text is shuffled; what is, is
    cut down before as far as a task goes, so an id that many rows share is no large group.
    """
    best, last = F.struct("_time", "_path", "text_sha256", "_row"), F.struct("segment", "text_sha256")
    found = rows.filter(F.col(id_col).isNotNull()).select(id_col, best.alias("_best")).unionByName(earlier.select(id_col, last.alias("_last")), allowMissingColumns=True)
    taken = found.groupBy(id_col).agg(F.max("_best").alias("_best"), F.max("_last").alias("_last")).filter("_best IS NOT NULL AND NOT (_best.text_sha256 <=> _last.text_sha256)").select("_best.*")
    bit = F.col("_row") % BITS
    bits = taken.groupBy("_path", stretch().alias("_bits")).agg(F.bitmap_construct_agg(bit).alias("_taken"), F.max(bit).alias("_most"))
    return bits.select("_path", "_bits", F.substring("_taken", F.lit(1), (F.floor(F.col("_most") / 8) + 1).cast("int")).alias("_taken"))


def stretch() -> Column:
    return F.floor(F.col("_row") / BITS)


def taken(rows: DataFrame, choice: DataFrame) -> DataFrame:
    """The rows that ``choice`` takes. They stay where they are: a bit for each row of the batch is broadcast."""
    bit = F.col("_row") % BITS
    byte = F.conv(F.hex(F.substring("_taken", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_bits", stretch()).join(F.broadcast(choice), ["_path", "_bits"])
    return met.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("_bits", "_taken")


def live_documents(spark: SparkSession, output: str, schema: StructType) -> DataFrame:
    """Each document's last row, with its segment."""
    rows = spark.read.schema(schema).parquet(f"{output}/documents")
    others = [c for c in rows.columns if c not in (schema[0].name, "segment")]
    best = rows.groupBy(schema[0].name).agg(F.max("segment").alias("segment"), F.max_by(F.struct(*others), "segment").alias("_best"))
    return best.select(schema[0].name, "_best.*", "segment")


def live(spark: SparkSession, output: str, schemas: dict[str, StructType]) -> DataFrame:
    """The postings that count: those of each document's last segment.

    Up to MOST_VOID replaced documents are broadcast, and the postings stay where they are; more meet them by a shuffle. A segment
    whose documents are not written does not count yet.
    """
    key = schemas["documents"][0].name
    documents = spark.read.schema(schemas["documents"]).parquet(f"{output}/documents").select(key, "segment")
    seen = documents.groupBy(key).agg(F.collect_set("segment").alias("_in")).filter(F.size("_in") > 1)
    void = seen.select(key, F.explode(F.array_except("_in", F.array(F.array_max("_in")))).alias("segment"))
    void = F.broadcast(void) if void.count() <= MOST_VOID else void
    whole = spark.read.schema(schemas["postings"]).parquet(f"{output}/postings").join(F.broadcast(documents.select("segment").distinct()), "segment", "left_semi")
    return whole.join(void, [key, "segment"], "left_anti")


def streamed(path: str) -> str:
    """The path as a pattern that it alone matches: a file stream takes a single file only where a pattern names it."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() and not set(path) & set("*?[{") else path


def schemas_of(documents: DataFrame, config: dict) -> dict[str, StructType]:
    """The schemas of the two tables, for a table of documents."""
    own = documents.schema[config["id"]]
    segment = StructField("segment", LongType())
    kept = [documents.schema[c] for c in config["kept"]]
    made = lexical.postings(documents, config["id"], config["text"]).schema
    return {"documents": StructType([own, StructField("text_sha256", StringType()), StructField("dl", LongType()), *kept, segment]), "postings": StructType([*made.fields, segment])}


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> list[dict]:
    """Take what is new in ``documents`` into the index under ``output``; what each batch read and wrote.

    Defined cases: rows without an id are left out and counted; a null text has no words; a document that comes again with
    the text it has is left as it is; one with another text replaces the earlier one; a run that finds no new file changes nothing.
    """
    found = spark.read.parquet(documents)
    key, words = config["id"], config["text"]
    columns = list(dict.fromkeys([key, words, *config["kept"]]))
    schemas = schemas_of(found, config)
    for name, schema in schemas.items():  # so that both tables can be read before the first batch
        spark.createDataFrame([], schema).write.mode("append").partitionBy("segment").parquet(f"{output}/{name}")
    batches: list[dict] = []

    def index(rows: DataFrame, segment: int) -> None:
        session = rows.sparkSession
        # what an attempt at this very batch left behind does not count
        earlier = session.read.schema(schemas["documents"]).parquet(f"{output}/documents").filter(F.col("segment") < segment)
        choice = chosen(rows, earlier, key).persist()
        try:
            new, number = taken(rows, choice), F.lit(segment).cast("long")
            dealt = new.select(key, words).hint("rebalance", key)  # whatever the sizes of files and row groups
            _overwrite(lexical.postings_in_order(dealt, key, words).withColumn("segment", number), f"{output}/postings")
            sized = new.withColumn("dl", F.size(text.tokens(words)).cast("long")).withColumn("segment", number)
            _overwrite(sized.select(schemas["documents"].fieldNames()), f"{output}/documents")
        finally:
            choice.unpersist()
        read, nameless = rows.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
        wrote = {name: session.read.schema(schemas[name]).parquet(f"{output}/{name}").filter(F.col("segment") == segment).count() for name in schemas}
        batches.append({"segment": segment, "read": read, "without_id": nameless, **wrote})
        log.info("segment %d: read %d rows of %s (%d without id), wrote %d documents and %d postings to %s", segment, read, documents, nameless, wrote["documents"], wrote["postings"], output)

    digest = F.sha2(F.coalesce(F.col(words), F.lit("")).cast("binary"), 256)
    place = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_modification_time", "_time"), ("file_path", "_path"), ("row_index", "_row"))]
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(streamed(documents))
    stream = stream.select(*columns, digest.alias("text_sha256"), *place)
    query = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d new batches from %s", len(batches), documents)
    return batches


def _overwrite(rows: DataFrame, folder: str) -> None:
    """Write rows over the segments that they belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(folder)


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="index_documents", description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    try:
        run(spark, args.documents, args.output, args.checkpoint, configuration(args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
