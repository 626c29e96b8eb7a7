import os

import pytest

from lodestone.operators.search import candidate_limit
from lodestone.plans.engine import Engine, hashed_embedder
from lodestone.plans.store import Store, StoreError


def engine(spark, base, **more):
    return Engine(spark, str(base), hashed_embedder(256), 256, capacity=8, overlap=2, **more)


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "in"
    (top / ".hidden").mkdir(parents=True)
    (top / "a.txt").write_text("alpha beta gamma delta epsilon zeta eta theta iota kappa")
    (top / "b.md").write_text("SQLITE_BUSY café こんにちは")
    (top / ".hidden" / "x.txt").write_text("hidden words")
    (top / "_c.txt").write_text("alpha again")
    return top


def test_sync_cycle(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    first = e.ingest([str(tree)])
    assert first == {"documents": 4, "chunks": 5, "unchanged": 0, "deleted": 0, "failed": 0}
    assert e.ingest([str(tree)])["unchanged"] == 4
    (tree / "a.txt").write_text("alpha only")
    os.rename(tree / "_c.txt", tree / "d.txt")
    third = e.ingest([str(tree)])
    assert (third["documents"], third["unchanged"], third["deleted"]) == (2, 2, 1)
    status = e.status()
    assert (status["documents"], status["chunks"], status["embeddings"]) == (4, 4, 4)
    assert len(e.sources()) == 1


def test_failure_keeps_old_document(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    (tree / "a.txt").write_bytes(b"\0binary")
    assert e.ingest([str(tree)])["failed"] == 1
    assert e.status()["documents"] == 4
    assert [r["uri"].rsplit("/", 1)[1] for r in e.search("kappa", "lexical").collect()] == ["a.txt"]
    run = e.store.snapshot().manifest["runs"][-1]
    assert run["status"] == "partial" and e.store.snapshot().manifest["failures"][run["id"]][0][1] == "binary_input"


def test_runs_and_seen_marks(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    e._record({"id": "lost", "kind": "ingest", "status": "running", "started_at": "", "counts": {}})
    e.ingest([str(tree)])
    now = e.store.snapshot()
    assert [r["status"] for r in now.manifest["runs"]] == ["completed", "interrupted", "completed"]
    assert {r["last_seen_run"] for r in now.table("documents").collect()} == {now.manifest["runs"][-1]["id"]}


def test_bad_vectors_change_nothing(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    (tree / "a.txt").write_text("new text")
    e.embed = lambda texts: [[2.0] * 256 for _ in texts]
    assert e.ingest([str(tree)])["failed"] == 1
    assert e.search("kappa", "lexical").count() == 1


def test_one_bad_document_keeps_its_old_state_and_others_go_on(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    (tree / "a.txt").write_text("poison words")
    (tree / "b.md").write_text("fresh words")
    good = hashed_embedder(256)

    def embed(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("out of luck")
        return good(texts)

    e.embed = embed
    got = e.ingest([str(tree)])
    assert (got["documents"], got["failed"], got["unchanged"]) == (1, 1, 2)
    assert e.search("kappa", "lexical").count() == 1 and e.search("fresh", "lexical").count() == 1 and e.search("poison", "lexical").count() == 0
    run = e.store.snapshot().manifest["runs"][-1]
    assert e.store.snapshot().manifest["failures"][run["id"]][0][2] == "out of luck"
    e.embed = good
    assert e.ingest([str(tree)])["documents"] == 1 and e.search("poison", "lexical").count() == 1


def test_unchanged_bytes_are_not_extracted_again(spark, tmp_path, tree):
    mark = tmp_path / "calls"
    tool = tmp_path / "tool.sh"
    tool.write_text(f'#!/bin/sh\necho x >> {mark}\ncat "$1"\n')
    tool.chmod(0o755)
    (tree / "c.odd").write_text("odd words")
    e = engine(spark, tmp_path / "store", custom={"odd": [str(tool), "{path}"]})
    assert e.ingest([str(tree)])["documents"] == 5
    calls = len(mark.read_text().split())
    assert e.ingest([str(tree)])["unchanged"] == 5 and len(mark.read_text().split()) == calls
    (tree / "c.odd").write_text("other words")
    assert e.ingest([str(tree)])["documents"] == 1 and len(mark.read_text().split()) > calls


def test_failures_above_those_kept_are_counted(spark, tmp_path, tree, monkeypatch):
    from lodestone.plans import engine as module

    monkeypatch.setattr(module, "KEPT_FAILURES", 1)
    e = engine(spark, tmp_path / "store")
    (tree / "a.txt").write_bytes(b"\0binary")
    (tree / "b.md").write_bytes(b"\0binary")
    assert e.ingest([str(tree)])["failed"] == 2
    now = e.store.snapshot().manifest
    assert len(now["failures"][now["runs"][-1]["id"]]) == 1


def test_rebuild_without_all_vectors_is_not_activated(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    e.embed = lambda texts: [[2.0] * 256 for _ in texts]
    with pytest.raises(StoreError):
        e.rebuild()
    run = e.store.snapshot().manifest["runs"][-1]
    assert (run["kind"], run["status"], run["counts"]) == ("rebuild", "partial", {"chunks": 0, "failed": 5})
    assert e.store.snapshot().generation() == 1
    e.embed = hashed_embedder(256)
    assert e.rebuild() == 2 and e.status()["active_generation"] == 2


def test_search_modes_filters_and_rebuild(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree / "a.txt"), str(tree / "b.md")])
    assert e.status()["roots"] == 2
    hits = e.search("alpha beta", "hybrid", 5).collect()
    assert hits[0]["rank"] == 1 and hits[0]["uri"].endswith("a.txt") and hits[0]["fusion_score"] == pytest.approx(2 / 61)
    root = e.sources()[0]["identity"]
    assert hits[0]["source"] == root and hits[0]["source_metadata"] == "{}" and hits[0]["locations"] == [] and hits[-1]["bytes"] > hits[0]["bytes"] > len(hits[0]["text"])
    assert e.search("alpha beta", "hybrid", 5, budget=hits[-1]["bytes"]).count() == len(hits)
    with pytest.raises(Exception, match="response_limit"):
        e.search("alpha beta", "hybrid", 5, budget=hits[-1]["bytes"] - 1).collect()
    assert e.search("alpha", "semantic", 5, media_type="text/markdown").count() == 1
    assert e.search("alpha", "hybrid", 5, root="nowhere").count() == 0
    assert e.search("alpha", "semantic", 5, root=str(tree / "a.txt")).count() == 2
    generation = e.rebuild()
    assert generation == 2 and e.status()["active_generation"] == 2 and e.status()["embeddings"] == e.status()["chunks"]
    assert e.remove("file://" + os.path.realpath(tree / "a.txt")) == 1 and e.status()["roots"] == 1
    assert e.remove("unknown") == 0


def test_incomplete_generation_cannot_be_activated(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    now = e.store.snapshot()
    e.store.commit(now.manifest | {"generations": now.manifest["generations"] + [{"id": 2, "status": "building"}]}, {})
    with pytest.raises(StoreError):
        e._activate(e.store.snapshot(), 2)
    assert e.store.snapshot().generation() == 1


def test_drift_of_a_generation_that_is_being_built(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    with pytest.raises(StoreError):
        e.drift()
    good = hashed_embedder(256)
    e.embed = lambda texts: [[-v[0] if "SQLITE_BUSY" in t else v[0], *v[1:]] if v[0] else v for t, v in zip(texts, good(texts))]
    assert e.rebuild(activate=False) == 2
    got = e.drift().first()
    assert got["compared"] == e.status()["chunks"] and got["least_cosine"] <= 1.0 + 1e-6
    assert e.store.snapshot().generation() == 1


def test_vectors_of_other_models_cuts_or_kinds_are_not_mixed(spark, tmp_path, tree):
    base = tmp_path / "store"
    e = engine(spark, base)
    e.ingest([str(tree / "a.txt")])
    assert e.store.snapshot().manifest["flags"] == {"synthetic_vectors": True}
    real = Engine(spark, str(base), lambda texts: hashed_embedder(256)(texts), 256, capacity=8, overlap=2)
    for act in (lambda: real.ingest([str(tree)]), lambda: real.search("alpha"), real.rebuild):
        with pytest.raises(StoreError, match="synthetic"):
            act()
    other = engine(spark, base, model="other")
    for act in (lambda: other.ingest([str(tree)]), lambda: other.search("alpha")):
        with pytest.raises(StoreError, match="model injected, not other"):
            act()
    assert other.rebuild(activate=False) == 2
    with pytest.raises(StoreError, match="generation 2 has model other"):  # another model can't finish what it began
        e.rebuild()
    assert other.rebuild() == 2 and other.search("alpha").count() == 2
    cut = Engine(spark, str(base), hashed_embedder(256), 256, capacity=9, overlap=2, model="other")
    with pytest.raises(StoreError, match="chunking"):
        cut.rebuild()
    own = Engine(spark, str(tmp_path / "real"), lambda texts: hashed_embedder(256)(texts), 256, capacity=8, overlap=2)
    own.ingest([str(tree / "a.txt")])
    assert own.search("alpha").count() == 2
    with pytest.raises(StoreError, match="real"):
        engine(spark, tmp_path / "real").ingest([str(tree)])


def test_pinned_snapshot_and_lock(spark, tmp_path, tree):
    e = engine(spark, tmp_path / "store")
    e.ingest([str(tree)])
    pinned = e.store.snapshot()
    (tree / "e.txt").write_text("one more")
    e.ingest([str(tree)])
    assert pinned.table("documents").count() == 4 and e.store.snapshot().table("documents").count() == 5
    with e.store.writer():
        with pytest.raises(StoreError):
            with e.store.writer(wait=0.1):
                pass
    with e.store.writer(wait=0.1):
        pass


def test_lock_of_a_lost_writer_is_taken_over(spark, tmp_path, monkeypatch):
    from lodestone.plans import store as module

    s = Store(spark, str(tmp_path / "store"))
    lost = s.snapshot().manifest
    assert s.files.create("_LOCK-7")
    with pytest.raises(StoreError):
        with s.writer(wait=0.1):
            pass
    monkeypatch.setattr(module, "LEASE", 0.4)
    with s.writer(wait=5):
        assert list(s.files.ages("_LOCK-")) == ["_LOCK-8"]
        with pytest.raises(StoreError):  # the owner touches its lock
            with s.writer(wait=1.5):
                pass
        s.commit(s.snapshot().manifest, {})
    assert not s.files.ages("_LOCK-")
    with pytest.raises(StoreError):
        s.commit(lost, {})


def test_newer_schema_is_refused_and_older_migrated(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.commit(s.snapshot().manifest | {"schema_version": 1}, {})
    assert s.migrate() and not s.migrate()
    s.commit(s.snapshot().manifest | {"schema_version": 99}, {})
    with pytest.raises(StoreError):
        s.snapshot()


def test_candidate_limit():
    assert [candidate_limit("hybrid", n) for n in (1, 100, 5000)] == [100, 400, 4096]
    assert candidate_limit("lexical", 7) == 7
