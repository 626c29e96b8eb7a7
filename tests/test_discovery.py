import os
import subprocess

import pytest

from lodestone.sources import discovery, extractors, inputs
from test_engine import engine


def walk(top):
    """(path, ok) of all files below a folder, one by one: what the tasks have to find."""
    try:
        entries = list(os.scandir(top))
    except OSError:
        yield top, False
        return
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            yield from walk(e.path)
        elif not (e.is_symlink() and os.path.isdir(e.path)):
            yield e.path, os.path.isfile(e.path)


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "in"
    for i in range(7):
        deep = top / f"d{i}" / "x" / "y" / f".z{i}"
        deep.mkdir(parents=True)
        (deep / f"f{i}.TXT").write_text(f"words {i}")
        (top / f"d{i}" / "same.md").write_text("the same")
    (top / ".gitignore").write_text("ignored")
    (top / "ignored").write_text("x")
    (top / "link").symlink_to(top / "ignored")
    (top / "cycle").symlink_to(top)
    (top / "d0" / "up").symlink_to(top / "d1")
    (top / "empty").mkdir()
    return top


def listed(spark, top, **more):
    return sorted((r["path"], r["kind"] == discovery.FILE) for r in discovery.listing(spark, str(top), **more).collect())


@pytest.mark.parametrize("budget", [1, 5, 100_000])
def test_tasks_find_what_a_walk_finds(spark, tree, budget):
    assert listed(spark, tree, budget=budget) == sorted(walk(str(tree)))


def test_what_can_not_be_read_makes_a_root_incomplete(spark, tree, monkeypatch):
    root = inputs.prepare(str(tree))
    found = inputs.discover(spark, root, "unused")
    assert root.complete and root.items == [] and found.count() == 17
    one = found.filter("extension = 'txt'").orderBy("uri").first()
    assert one["uri"] == "file://" + one["path"] and one["source_root_id"] == root.id and one["modified_ns"] and one["content"] is None
    (tree / "d3" / "broken").symlink_to(tree / "nowhere")
    odd = os.path.join(os.fsencode(tree), b"bad\xff.txt")
    with open(odd, "w") as f:
        f.write("x")
    os.mkfifo(tree / "pipe")
    root = inputs.prepare(str(tree))
    assert inputs.discover(spark, root, "unused").count() == 17 and not root.complete
    scan = os.scandir

    def closed(at):
        if at.endswith("d5"):
            raise PermissionError(at)
        return scan(at)

    monkeypatch.setattr(os, "scandir", closed)
    bad = [p for p, kind, *_ in discovery.walked([str(tree)], 99) if kind == discovery.BAD]
    assert str(tree / "d5") in bad and len(bad) == 4


def test_tasks_hand_on_what_they_do_not_get_to(tree):
    first = list(discovery.walked([str(tree)], 3))
    left = [p for p, kind, *_ in first if kind == discovery.OPEN]
    assert left and not any(kind == discovery.BAD for _, kind, *_ in first)
    seen = {p for p, kind, *_ in first if kind == discovery.FILE}
    for p in left:
        seen |= {x for x, kind, *_ in discovery.walked([p], 10**6) if kind == discovery.FILE}
    assert seen == {p for p, ok in walk(str(tree)) if ok}


def git(at, *args):
    subprocess.run(["git", "-C", str(at), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


@pytest.fixture
def repository(tmp_path):
    at = tmp_path / "repo"
    (at / "sub").mkdir(parents=True)
    (at / "a.md").write_text("alpha words")
    (at / "copy.md").write_text("alpha words")
    (at / "sub" / "b.txt").write_text("beta words")
    (at / "sub" / "noend").write_bytes(b"plain")
    (at / "link.txt").symlink_to("sub/b.txt")
    (at / "folder").symlink_to("sub")
    git(tmp_path, "init", "-q", str(at))
    git(at, "add", "-A")
    git(at, "commit", "-qm", "one")
    return at


def test_a_repository_is_read_from_the_store(spark, tmp_path, repository, monkeypatch):
    real, into = inputs.clone, []

    def local(url, folder):
        into.append(folder)
        return real("file://" + str(repository), folder) | {"repository_url": url}

    monkeypatch.setattr(inputs, "clone", local)
    base = str(tmp_path / "store")
    root = inputs.prepare("https://example.org/r.git")
    rows = {r["uri"].split("#")[1]: r for r in inputs.discover(spark, root, base).collect()}
    assert {k: bytes(r["content"]) for k, r in rows.items()} == {"a.md": b"alpha words", "copy.md": b"alpha words", "sub/b.txt": b"beta words", "sub/noend": b"plain", "link.txt": b"beta words"}
    assert root.complete and not os.path.exists(into[0]) and {k: r["extension"] for k, r in rows.items()} == {"a.md": "md", "copy.md": "md", "sub/b.txt": "txt", "sub/noend": "", "link.txt": "txt"}
    assert all(r["path"] is None and "example.org" in r["metadata"] for r in rows.values())
    blobs = spark.read.parquet(f"{base}/{root.id}/blobs")
    assert blobs.count() == 3
    (repository / "a.md").write_text("gamma words")
    (repository / "gone").symlink_to("nowhere")
    git(repository, "add", "-A")
    git(repository, "commit", "-qm", "two")
    found = inputs.discover(spark, root, base, most=10)
    assert spark.read.parquet(f"{base}/{root.id}/blobs").count() == 4 and not root.complete
    texts = {r["uri"].split("#")[1]: r["text"] or r["error"] for r in extractors.extracted(found, most=11).collect()}
    assert texts["a.md"] == "gamma words" and texts["copy.md"] == "alpha words" and texts["sub/noend"] == "plain"


def test_ingest_of_a_repository_prunes_and_keeps(spark, tmp_path, repository, monkeypatch):
    real = inputs.clone
    monkeypatch.setattr(inputs, "clone", lambda url, folder: real("file://" + str(repository), folder) | {"repository_url": url, "commit": "fixed"})
    e = engine(spark, tmp_path / "store")
    assert e.ingest(["https://example.org/r.git"])["documents"] == 5
    (repository / "a.md").unlink()
    (repository / "sub" / "b.txt").write_text("other words")
    git(repository, "add", "-A")
    git(repository, "commit", "-qm", "two")
    got = e.ingest(["https://example.org/r.git"])
    assert (got["documents"], got["unchanged"], got["deleted"]) == (2, 2, 1)
    assert {r["uri"].split("#")[1] for r in e.search("other", "lexical").collect()} == {"sub/b.txt", "link.txt"}
