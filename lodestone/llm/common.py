"""Helpers that the corpus operators share: shared scratch space and bounded Python batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that a Python worker gets, whatever the lengths of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def scratch(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all tasks run in this process (tests, a
    laptop) a local folder is made and set; on a cluster an unset folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, so what is built on the result survives the loss of one.
    """
    spark = df.sparkSession
    at = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``keep`` wrote and that nothing will read again."""
    for df in frames:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, so that a batch of long texts fits a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What a worker process remembers between tasks, by the module that fills it.
remembered: dict[str, dict] = {}


def tidy(function):
    """A batch function that makes room: workers live on from task to task.

    What other operators remembered in this worker goes at the start; freed memory is given back at the end.
    """
    owner = function.__module__

    def run(batches):
        for module in [m for m in remembered if m != owner]:
            remembered[module].clear()
        give_back()
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def groups(texts: list[str], chars: int = 400_000):
    """Runs of texts of about so many characters; one longer text is a run of its own."""
    run: list[str] = []
    n = 0
    for t in texts:
        if run and n + len(t) > chars:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Tasks for an explicit deal: as many as shuffles have."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_key(col: str):
    """Sixteen bytes that stand for a text; null and empty texts share one key."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit(""))))
