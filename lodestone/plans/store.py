"""Versioned snapshots of the corpus tables.

Every commit writes new Parquet folders and then a new manifest; one atomic rename makes that manifest current.
Readers pin the manifest that they found, so they see one state throughout; a crash before the rename leaves the old
state whole. Documents and chunks are kept per root, vectors per generation and root, so that a commit rewrites
what it touches only. All paths go through Spark's file systems.

The text index grows by segments: a commit adds the postings of its new chunks, and the documents whose postings in earlier
segments are void. Segments of one root are merged now and then; a posting keeps the number of the segment that it came in.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lexical

SCHEMA_VERSION = 3
TABLES = {
    "documents": "document_id string, source_root_id string, uri string, content_hash string, text_hash string, media_type string, extractor string, recipe string, size_bytes long, modified_ns string, metadata string, last_seen_run string",
    "chunks": "chunk_id string, document_id string, source_root_id string, media_type string, ordinal long, text string, token_start long, token_end long, byte_start long, byte_end long, chunk_hash string, terms int",
    "postings": "term string, chunk_id string, document_id string, segment long, dl int, positions array<int>, tf int",
    "removed": "document_id string, before long",
    "embeddings": "chunk_id string, generation_id long, embedding array<float>",
}
STATES = ("building", "active", "retired")
#: Locks are files with this name and a number; an owner that does not touch its lock for so many seconds has lost it.
LOCK, LEASE = "_LOCK-", 60.0
#: What a migration has done so far.
MIGRATION = "_MIGRATION"


class StoreError(Exception):
    """A state that the store refuses to enter or to leave."""


class Files:
    """The few file operations that the store needs, on whatever file system a path belongs to."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.base = spark._jvm, base.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write aside, then rename over the old file in one step."""
        aside = self._path(f".{name}-{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if self.base.count(":") else self.fs.getUri(), self.conf).rename(aside, self._path(name), options)

    def create(self, name: str) -> bool:
        """Make an empty file; False if there is one already."""
        self.fs.mkdirs(self._path(""))
        return self.fs.createNewFile(self._path(name))

    def ages(self, prefix: str) -> dict[str, float]:
        """Files whose names begin so, with the seconds since they were last touched."""
        if not self.fs.exists(self._path("")):
            return {}
        found = [f for f in self.fs.listStatus(self._path("")) if f.getPath().getName().startswith(prefix)]
        return {f.getPath().getName(): time.time() - f.getModificationTime() / 1000 for f in found}

    def touch(self, name: str) -> None:
        self.fs.setTimes(self._path(name), int(time.time() * 1000), -1)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def empty_manifest() -> dict:
    lists = {"generations": [], "models": [], "runs": []}
    return {"schema_version": SCHEMA_VERSION, "version": 0, "tables": {t: {} for t in TABLES}, "roots": {}, "sums": {}, "segments": {}, "failures": {}, "flags": {}} | lists


class Snapshot:
    """One manifest, pinned."""

    def __init__(self, spark: SparkSession, base: str, manifest: dict):
        self.spark, self.base, self.manifest = spark, base, manifest

    def table(self, name: str, keys: list[str] | None = None) -> DataFrame:
        paths = [p for k, p in self.manifest["tables"].get(name, {}).items() if keys is None or k in keys]
        reader = self.spark.read.schema(TABLES[name])
        return reader.parquet(*[f"{self.base}/{p}" for p in sorted(paths)]) if paths else self.spark.createDataFrame([], TABLES[name])

    def generation(self, status: str = "active") -> int | None:
        found = [g["id"] for g in self.manifest["generations"] if g["status"] == status]
        return max(found) if found else None

    def vectors(self, generation: int) -> DataFrame:
        return self.table("embeddings", [k for k in self.manifest["tables"]["embeddings"] if k.split("/")[0] == str(generation)])

    def active_vectors(self) -> DataFrame:
        active = self.generation()
        return self.vectors(active) if active is not None else self.spark.createDataFrame([], TABLES["embeddings"])


    def live_postings(self, keys: list[str] | None = None) -> DataFrame:
        """The postings of the chunks that there are: those that no later commit has made void."""
        void = self.table("removed", None if keys is None else [k for k in self.manifest["tables"]["removed"] if k.split("/")[0] in {x.split("/")[0] for x in keys}])
        rows = self.table("postings", keys)
        void = void.groupBy(F.col("document_id").alias("_void")).agg(F.max("before").alias("_before"))
        return rows.join(void, (F.col("document_id") == F.col("_void")) & (F.col("segment") < F.col("_before")), "left_anti")

    def text_sums(self) -> tuple[int, int]:
        """How many chunks there are, and how many tokens they have."""
        sums = self.manifest["sums"].values()
        return sum(x["chunks"] for x in sums), sum(x["terms"] for x in sums)


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.files = spark, base.rstrip("/"), Files(spark, base)

    def snapshot(self) -> Snapshot:
        held = self.files.read("_CURRENT")
        manifest = json.loads(held) if held else empty_manifest()
        if manifest["schema_version"] > SCHEMA_VERSION:
            raise StoreError(f"schema {manifest['schema_version']} is newer than {SCHEMA_VERSION}")
        return Snapshot(self.spark, self.base, manifest)

    def current(self) -> Snapshot:
        """The snapshot, which must be of this version: an older one lacks what is derived from its texts."""
        now = self.snapshot()
        if now.manifest["schema_version"] < SCHEMA_VERSION:
            raise StoreError(f"schema {now.manifest['schema_version']} is older than {SCHEMA_VERSION}: migrate first")
        return now

    def migrate(self) -> bool:
        """Bring an older state to this version: what it lacks is made from stored texts, beside it, checked, and made current in one step.

        Roots that are done are noted, so that a migration that was stopped goes on with the others; until the last step
        readers see the old state. Another commit in between makes it begin anew.
        """
        now = self.snapshot()
        if now.manifest["schema_version"] == SCHEMA_VERSION:
            return False
        with self.writer():
            now = self.snapshot()
            old = now.manifest
            note = json.loads(self.files.read(MIGRATION) or "{}")
            done = note.get("roots", {}) if note.get("version") == old["version"] else {}
            for root in sorted(set(old["tables"]["chunks"]) - set(done)):
                done[root] = self._derived(now, root, old["version"] + 1)
                self.files.replace(MIGRATION, json.dumps({"version": old["version"], "roots": done}))
            new = empty_manifest() | old | {"schema_version": SCHEMA_VERSION, "sums": {r: d["sums"] for r, d in done.items()}, "segments": {d["segment"]: d["sums"]["terms"] for d in done.values()}}
            tables = {t: {} for t in TABLES} | old["tables"] | {"chunks": {r: d["chunks"] for r, d in done.items()}, "postings": {d["segment"]: d["path"] for d in done.values()}}
            self._swap(new, tables)
            self.files.delete(MIGRATION)
        return True

    def _derived(self, now: Snapshot, root: str, segment: int) -> dict:
        """A root's chunks with their numbers of tokens, and its first segment of postings; both must account for each other."""
        rows = now.table("chunks", [root]).withColumn("terms", F.size(text.tokens("text")))
        chunks = self._written("chunks", root, rows)
        made = self.spark.read.schema(TABLES["chunks"]).parquet(f"{self.base}/{chunks}")
        key = f"{root}/{segment}"
        path = self._written("postings", key, lexical.postings(made, carried=("document_id",)).withColumn("segment", F.lit(segment).cast("long")))
        n, terms = made.agg(F.count("*"), F.coalesce(F.sum("terms"), F.lit(0))).first()
        (tokens,) = self.spark.read.schema(TABLES["postings"]).parquet(f"{self.base}/{path}").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()
        if n != now.table("chunks", [root]).count() or tokens != terms:
            raise StoreError(f"the index of root {root} does not account for its chunks")
        return {"chunks": chunks, "segment": key, "path": path, "sums": {"chunks": n, "terms": terms}}

    def writer(self, wait: float = 2.0) -> "_Writer":
        return _Writer(self.files, wait)

    def commit(self, manifest: dict, changes: dict[str, dict[str, DataFrame | None]]) -> Snapshot:
        """Write the changed parts of tables (None drops a part), then make the new manifest current; ``manifest`` must be of the current version."""
        tables = {t: dict(parts) for t, parts in manifest["tables"].items()}
        for name, parts in changes.items():
            for key, rows in parts.items():
                if rows is None:
                    tables[name].pop(key, None)
                    continue
                tables[name][key] = self._written(name, key, rows)
        return self._swap(manifest, tables)

    def _written(self, name: str, key: str, rows: DataFrame) -> str:
        """Write a part of a table; its path, which no manifest names yet."""
        path = f"{name}/{key}/{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        if name == "postings":
            lexical.write_postings(rows.select(*columns), f"{self.base}/{path}", folders=False)
        else:
            rows.select(*columns).write.parquet(f"{self.base}/{path}")
        return path

    def _swap(self, manifest: dict, tables: dict) -> Snapshot:
        """Make a manifest current, if the one that it was made from still is."""
        if self.snapshot().manifest["version"] != manifest["version"]:
            raise StoreError("another writer has committed")
        new = manifest | {"tables": tables, "version": manifest["version"] + 1}
        self.files.replace("_CURRENT", json.dumps(new, sort_keys=True))
        return Snapshot(self.spark, self.base, new)


class _Writer:
    """One writer at a time; a second one waits briefly, then fails.

    A lock is a file with a number, which its owner touches while it works. One that was not touched for LEASE seconds
    belongs to a writer that is gone: whoever first makes the file with the next number takes over. A writer that
    was only slow finds another version when it commits, and fails then.
    """

    def __init__(self, files: Files, wait: float):
        self.files, self.wait, self.ended = files, wait, threading.Event()

    def __enter__(self):
        end = time.monotonic() + self.wait
        while not (mine := self._taken()):
            if time.monotonic() > end:
                raise StoreError("another writer holds the lock")
            time.sleep(0.05)
        self.name = mine
        self.beat = threading.Thread(target=self._touch, daemon=True)
        self.beat.start()

    def _taken(self) -> str | None:
        ages = {int(name[len(LOCK) :]): age for name, age in self.files.ages(LOCK).items()}
        last = max(ages, default=0)
        if ages and ages[last] < LEASE or not self.files.create(f"{LOCK}{last + 1}"):
            return None
        for n in ages:
            self.files.delete(f"{LOCK}{n}")
        return f"{LOCK}{last + 1}"

    def _touch(self) -> None:
        while not self.ended.wait(LEASE / 4):
            self.files.touch(self.name)

    def __exit__(self, *_):
        self.ended.set()
        self.beat.join()
        self.files.delete(self.name)
