"""What is behind folders and repositories, found by tasks and kept where all executors can read it.

Folders are listed in rounds: each task walks some folders and hands on those that it does not get to, so neither the driver nor a
task holds a whole tree. A repository is cloned on the driver, which git needs, and copied from there to the shared store in
pieces of a bounded size: contents by their blob id, those only that are not there yet.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shared

#: Entries that a task lists before it hands folders on, rows of one batch, and bytes of one piece of a repository.
BUDGET, ROWS, PIECE = 100_000, 10_000, 32 << 20
FILE, BAD, OPEN = "file", "bad", "open"
LISTED = "path string, kind string, extension string, modified_ns string"


def extension(path: str) -> str:
    return os.path.splitext(path)[1][1:].lower()


def walked(folders: list[str], budget: int) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(path, kind, extension, modified_ns) of what is below some folders: files; what can't be read; and folders that are left to others.

    Dot files count, links to files too, links to folders don't. The first folder is listed in any case, so every round gets on.
    """
    waiting, seen = folders[::-1], 0
    while waiting:
        at = waiting.pop()
        if seen >= budget:
            yield at, OPEN, None, None
            continue
        seen += 1
        try:
            with os.scandir(at) as entries:
                for e in entries:
                    seen += 1
                    if e.is_dir(follow_symlinks=False):
                        waiting.append(e.path)
                    elif not (e.is_symlink() and os.path.isdir(e.path)):
                        yield _entry(e.path)
        except OSError:
            yield _sayable(at), BAD, None, None


def _entry(path: str) -> tuple[str, str, str | None, str | None]:
    try:
        if os.path.isfile(path) and path == _sayable(path):
            return path, FILE, extension(path), str(os.stat(path).st_mtime_ns)
    except OSError:
        pass
    return _sayable(path), BAD, None, None


def _sayable(path: str) -> str:
    """A path as text; names that are none are not followed."""
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def listing(spark: SparkSession, top: str, budget: int = BUDGET) -> DataFrame:
    """(path, kind, extension, modified_ns) of a folder's tree, written round by round under the shared folder.

    A round is one job over the folders that the one before left open; the driver learns only whether there are any.
    """
    import pyarrow as pa

    def walk(batches):
        folders = [p for batch in batches for p in batch.column(0).to_pylist()]
        rows: list[tuple] = []
        names = [c.split()[0] for c in LISTED.split(", ")]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

        for row in walked(folders, budget):
            rows.append(row)
            if len(rows) == ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()

    at = shared.new_folder(spark, "listing")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frontier, rounds = spark.createDataFrame([(top,)], "path string"), 0
    while frontier.limit(1).count():
        frontier.repartition(tasks if rounds else 1).mapInArrow(walk, LISTED).write.parquet(f"{at}/round={rounds}")
        frontier = spark.read.schema(LISTED).parquet(f"{at}/round={rounds}").filter(F.col("kind") == OPEN).select("path")
        rounds += 1
    return spark.read.schema(LISTED + ", round int").parquet(at).filter(F.col("kind") != OPEN).drop("round")


TREE, BLOBS = "path string, blob string", "blob string, content binary"


def tree_entries(folder: str) -> Iterator[tuple[str, str | None]]:
    """(path, blob id) of a checkout's commit. A link to a file of the tree stands for that file; one to a folder is left out; None stands for one that leads nowhere."""
    say = subprocess.Popen(["git", "-C", folder, "ls-tree", "-r", "-z", "HEAD"], stdout=subprocess.PIPE)
    held, links = b"", []
    while data := say.stdout.read(1 << 20):
        *entries, held = (held + data).split(b"\0")
        for entry in entries:
            head, _, name = entry.partition(b"\t")
            mode, kind, blob = head.decode().split()
            path = name.decode("utf-8", "surrogateescape")
            if mode == "120000":
                links.append(path)
            elif kind == "blob":
                yield path, blob if path == _sayable(path) else None
    if say.wait():
        raise OSError(f"git ls-tree failed in {folder}")
    for path in links:
        real = os.path.realpath(os.path.join(folder, path))
        inside = os.path.relpath(real, os.path.realpath(folder))
        if os.path.isdir(real):
            continue
        blob = _say(folder, "rev-parse", f"HEAD:{inside}") if os.path.isfile(real) and not inside.startswith("..") else None
        yield path, blob


def _say(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, text=True, timeout=60).stdout.strip()


def blob_contents(folder: str, wanted: Iterator[str], most: int) -> Iterator[tuple[str, bytes]]:
    """Contents by blob id, of at most ``most`` bytes and one more."""
    names = os.path.join(folder, ".git", "lodestone-wanted")
    with open(names, "w") as f:
        f.writelines(f"{blob}\n" for blob in wanted)
    with open(names) as f:
        say = subprocess.Popen(["git", "-C", folder, "cat-file", "--batch"], stdin=f, stdout=subprocess.PIPE)
        while head := say.stdout.readline():
            blob, _, size = head.decode().split()
            content = say.stdout.read(min(int(size), most + 1))
            rest = int(size) - len(content)
            while rest > 0:
                rest -= len(say.stdout.read(min(rest, 1 << 20)))
            say.stdout.read(1)
            yield blob, content
    if say.wait():
        raise OSError(f"git cat-file failed in {folder}")


def _in_pieces(spark: SparkSession, rows: Iterator[tuple], schema: str, at: str, size=lambda row: 100) -> None:
    """Append rows to a table, PIECE bytes at a time."""
    some: list[tuple] = []
    held = 0
    for row in rows:
        some.append(row)
        held += size(row)
        if held >= PIECE:
            spark.createDataFrame(some, schema).write.mode("append").parquet(at)
            some, held = [], 0
    spark.createDataFrame(some, schema).write.mode("append").parquet(at)


def stored_tree(spark: SparkSession, folder: str, base: str, most: int) -> tuple[DataFrame, bool]:
    """(path, blob, content) of a checkout from the store under ``base``, and whether all of the tree could be read.

    Blobs that the store has from earlier commits, or that several paths share, are not copied again. Nothing of the result
    needs the checkout.
    """
    tree = shared.new_folder(spark, "tree")
    _in_pieces(spark, tree_entries(folder), TREE, tree)
    entries = spark.read.schema(TREE).parquet(tree)
    _in_pieces(spark, iter(()), BLOBS, f"{base}/blobs")  # so that it can be read
    blobs = spark.read.schema(BLOBS).parquet(f"{base}/blobs")
    new = entries.filter("blob is not null").select("blob").distinct().join(blobs.select("blob"), "blob", "left_anti")
    wanted = shared.kept(new, "new-blobs")
    _in_pieces(spark, blob_contents(folder, (r[0] for r in wanted.toLocalIterator()), most), BLOBS, f"{base}/blobs", lambda row: len(row[1]) + 100)
    blobs = spark.read.schema(BLOBS).parquet(f"{base}/blobs")
    return entries.join(blobs, "blob"), not entries.filter("blob is null").limit(1).count()
