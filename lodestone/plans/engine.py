"""Ingest, rebuild, search and upkeep over a store."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batching, ids, text, vectors
from ..operators import chunking, dense, evaluate, lexical, search, sync
from ..sources import extractors, inputs
from .store import Snapshot, Store, StoreError

Embed = Callable[[list[str]], list[list[float]]]
KEPT_RUNS, KEPT_FAILURES = 100, 1000
#: As many segments of a root's text index as are merged at least.
FAN = 4
#: What an embedder gets at once: texts, and letters when all are as long as the longest.
BATCH_ITEMS, BATCH_LETTERS = 64, 1 << 18


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Byte ranges of white-space separated words: the tokenizer where no other is given."""
    raw = text.encode("utf-8")
    return [m.span() for m in re.finditer(rb"[^\x09-\x0d\x20]+", raw)]


def hashed_embedder(dimensions: int) -> Embed:
    """Deterministic unit vectors from words, for tests and dry runs; synthetic."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in t.lower().split() or [t]:
                h = hashlib.sha256(w.encode()).digest()
                v[int.from_bytes(h[:4], "little") % dimensions] += 1.0 if h[4] & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else [1.0] + [0.0] * (dimensions - 1))
        return out

    embed.synthetic = True
    return embed


class Engine:
    def __init__(self, spark: SparkSession, base: str, embed: Embed, dimensions: int, capacity: int = 510, overlap: int = 64, offsets=word_offsets, model: str = "injected", query_prefix: str = "", custom: dict | None = None, most_bytes: int = 64 << 20):
        self.spark, self.store, self.embed, self.dimensions = spark, Store(spark, base), embed, dimensions
        self.capacity, self.overlap, self.offsets, self.model, self.custom, self.most = capacity, overlap, offsets, model, custom or {}, most_bytes
        self.query_prefix = query_prefix
        self.synthetic = getattr(embed, "synthetic", False)

    def _made_by(self) -> dict:
        """What a generation of vectors is made by, and how its texts were cut."""
        return {"model": self.model, "dimensions": self.dimensions, "chunking": [self.capacity, self.overlap]}

    def _must_fit(self, now: Snapshot, keys: tuple[str, ...], status: str = "active") -> None:
        """Refuse a store whose vectors this engine's would not go with: synthetic and real ones, or ones of another model or cut."""
        flag = now.manifest["flags"].get("synthetic_vectors", False)
        if flag != self.synthetic and (flag or now.manifest["generations"]):
            raise StoreError(f"the store holds {'synthetic' if flag else 'real'} vectors, which do not go with {'real' if flag else 'synthetic'} ones: choose another store")
        mine = self._made_by()
        for g in now.manifest["generations"]:
            odd = [k for k in keys if g["status"] == status and k in g and g[k] != mine[k]]
            if odd:
                raise StoreError(f"generation {g['id']} has {odd[0]} {g[odd[0]]}, not {mine[odd[0]]}")

    def recipe(self, root: inputs.Root) -> str:
        """Everything that a stored document depends on besides its bytes."""
        parts = {"model": self.model, "dimensions": self.dimensions, "capacity": self.capacity, "overlap": self.overlap, "custom": self.custom, "root": root.metadata}
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()

    def ingest(self, names: list[str], stdin=None, fail_fast: bool = False) -> dict:
        """Sync every input; per root one commit, so a root is replaced as a whole or not at all."""
        counts = dict.fromkeys(("documents", "chunks", "unchanged", "deleted", "failed"), 0)
        with self.store.writer():
            run = hashlib.sha256(f"{datetime.now(timezone.utc).isoformat()}{names}".encode()).hexdigest()[:32]
            failures: list[tuple[str, str, str]] = []
            started = datetime.now(timezone.utc).isoformat()
            self._record({"id": run, "kind": "ingest", "status": "running", "started_at": started, "counts": {}})
            for name in names:
                try:
                    expanded = inputs.expand(name)
                except inputs.InputError as e:
                    failures.append((name, "input_failed", str(e)))
                    counts["failed"] += 1
                    continue
                for one in expanded:
                    try:
                        root = inputs.prepare(one, self.most, stdin=stdin)
                    except (inputs.InputError, OSError) as e:
                        failures.append((one, next((c for c in sync.ERROR_CODES if c in str(e)), sync.OTHER_ERROR), str(e)))
                        counts["failed"] += 1
                        continue
                    failures += self._ingest_root(root, run, counts, fail_fast)[: KEPT_FAILURES - len(failures)]
                    if fail_fast and counts["failed"]:
                        break
                if fail_fast and counts["failed"]:
                    break
            entry = {"id": run, "kind": "ingest", "status": "partial" if counts["failed"] else "completed", "started_at": started, "finished_at": datetime.now(timezone.utc).isoformat(), "counts": counts}
            self._record(entry, failures)
        return counts

    def _record(self, entry: dict, failures: list | None = None) -> None:
        """Put a run's state into the manifest; runs that an earlier process left unfinished are marked as interrupted."""
        now = self.store.snapshot().manifest
        others = [r | {"status": "interrupted"} if r["status"] == "running" else r for r in now["runs"] if r["id"] != entry["id"]]
        runs = (others + [entry])[-KEPT_RUNS:]
        kept = {r["id"] for r in runs}
        failed = {k: v for k, v in (now["failures"] | {entry["id"]: (failures or [])[:KEPT_FAILURES]}).items() if k in kept}
        self.store.commit(now | {"runs": runs, "failures": failed}, {})

    def _ingest_root(self, root: inputs.Root, run: str, counts: dict, fail_fast: bool) -> list[tuple[str, str, str]]:
        now = self.store.current()
        self._must_fit(now, ("model", "dimensions", "chunking"))
        found = inputs.discover(self.spark, root, f"{self.store.base}/_repositories", self.most)
        manifest, recipe = now.manifest, self.recipe(root)
        stored, old_chunks = now.table("documents", [root.id]), now.table("chunks", [root.id])
        items = found.withColumn("document_id", ids.document_id("source_root_id", "uri"))
        known = stored.filter(F.col("recipe") == recipe).select("document_id", F.struct("content_hash", "media_type", "extractor", "metadata").alias("known"))
        found = extractors.extracted(items.join(known, "document_id", "left"), self.most, self.custom)
        found = self._kept(found.withColumn("document_id", ids.document_id("source_root_id", "uri")).withColumn("recipe", F.lit(recipe)), "found")
        failed = self._failures(found.filter("error is not null").select("uri", "error"), counts)
        if failed and fail_fast:
            return failed
        state = sync.outcomes(stored, found.filter("error is null"), ["content_hash", "recipe", "metadata"])
        changed = state.filter("outcome <> 'unchanged'")
        docs = changed.select(
            "document_id", "source_root_id", "uri", "content_hash", ids.sha256_text("text").alias("text_hash"), "media_type", "extractor", "recipe", "size_bytes", "modified_ns", "metadata", F.lit(run).alias("last_seen_run"), "text"
        )
        made = self._kept(self._chunks(docs), "chunks")
        if manifest["generations"]:
            generation = now.generation()
        else:
            generation = 1
            manifest = manifest | {"generations": [{"id": 1, "status": "active"} | self._made_by()], "models": [{"id": self.model, "dimensions": self.dimensions}], "flags": manifest["flags"] | {"synthetic_vectors": self.synthetic}}
        new_vectors = self._kept(self._embedded(made, generation), "vectors")
        # a document with a chunk that got no vector keeps its old state
        faulty = self._kept(new_vectors.filter("error is not null").groupBy("document_id").agg(F.min("error").alias("error")), "faulty")
        failed += self._failures(docs.join(faulty, "document_id").select("uri", "error"), counts)
        if failed and fail_fast:
            return failed
        docs, made, new_vectors = (rows.join(faulty.select("document_id"), "document_id", "left_anti") for rows in (docs, made, new_vectors))
        gone = sync.pruned(stored, found, root.id, complete=root.kind in ("directory", inputs.GIT) and root.complete)
        seen = found.select("document_id", F.lit(run).alias("_seen"))  # failed items were seen too
        next_docs = sync.replaced(stored, docs.drop("text"), gone).join(seen, "document_id", "left").withColumn("last_seen_run", F.coalesce("_seen", "last_seen_run"))
        drop = docs.select("document_id").unionByName(gone.select("document_id")).distinct()
        next_chunks = old_chunks.join(drop, "document_id", "left_anti").unionByName(made)
        parts = {"documents": {root.id: next_docs}, "chunks": {root.id: next_chunks}, "embeddings": {}}
        manifest, index = self._indexed(manifest, root.id, made, old_chunks.join(drop, "document_id", "left_semi"))
        parts |= index
        key = f"{generation}/{root.id}"
        old = now.table("embeddings", [key])
        parts["embeddings"][key] = old.join(next_chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").unionByName(new_vectors.select("chunk_id", "generation_id", "embedding"))
        counts["documents"] += docs.count()
        counts["chunks"] += made.count()
        counts["unchanged"] += state.filter("outcome = 'unchanged'").count()
        counts["deleted"] += gone.count()
        entry = {"identity": root.identity, "kind": root.kind, "metadata": root.metadata, "last_attempted_run": run}
        entry["last_successful_run"] = run if not failed else manifest["roots"].get(root.id, {}).get("last_successful_run")
        self._merge_segments(self.store.commit(manifest | {"roots": manifest["roots"] | {root.id: entry}}, parts), root.id)
        return failed

    def _indexed(self, manifest: dict, root: str, made: DataFrame, void: DataFrame) -> tuple[dict, dict]:
        """The next segment of a root's text index: postings of new chunks, the documents whose earlier ones are void, and the sums."""
        segment = manifest["version"] + 1
        key = f"{root}/{segment}"

        def sums(rows: DataFrame) -> tuple[int, int]:
            return tuple(rows.agg(F.count("*"), F.coalesce(F.sum("terms"), F.lit(0))).first())

        more, less = sums(made), sums(void)
        had = manifest["sums"].get(root, {"chunks": 0, "terms": 0})
        out = manifest | {"sums": manifest["sums"] | {root: {"chunks": had["chunks"] + more[0] - less[0], "terms": had["terms"] + more[1] - less[1]}}}
        parts: dict = {}
        if more[0]:
            parts["postings"] = {key: lexical.postings(made, carried=("document_id",)).withColumn("segment", F.lit(segment).cast("long"))}
            out["segments"] = manifest["segments"] | {key: more[1]}
        if less[0]:
            parts["removed"] = {key: void.select("document_id", F.lit(segment).cast("long").alias("before")).distinct()}
        return out, parts

    def _merge_segments(self, now: Snapshot, root: str) -> None:
        """Merge the newest segments of a root while the next older one is no larger than twice all newer ones, once there are FAN such; all of them once void postings may be a half."""
        mine = {k: n for k, n in now.manifest["segments"].items() if k.split("/")[0] == root}
        newest = sorted(mine, key=lambda k: -int(k.split("/")[1]))
        some, held = [], 0
        for key in newest:
            if some and mine[key] > 2 * held:
                break
            some.append(key)
            held += mine[key]
        if sum(mine.values()) > 2 * now.manifest["sums"][root]["terms"]:
            some = newest
        elif len(some) < FAN:
            return
        rows = now.live_postings(some)
        left = rows.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        key = f"{root}/{now.manifest['version'] + 1}"
        segments = {k: n for k, n in now.manifest["segments"].items() if k not in some} | ({key: left} if left else {})
        parts: dict = {"postings": dict.fromkeys(some) | ({key: rows} if left else {})}
        if len(some) == len(newest):  # nothing void is left
            parts["removed"] = {k: None for k in now.manifest["tables"]["removed"] if k.split("/")[0] == root}
        self.store.commit(now.manifest | {"segments": segments}, parts)

    def _failures(self, rows: DataFrame, counts: dict) -> list[tuple[str, str, str]]:
        """The first failures (uri, error) with their codes; all of them are counted."""
        counts["failed"] += rows.count()
        first = rows.select("uri", sync.error_code(F.col("error")).alias("code"), "error").orderBy("uri").limit(KEPT_FAILURES)
        return [tuple(r) for r in first.collect()]

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written under the store once, so that what follows reads one result."""
        import uuid

        at = f"{self.store.base}/_work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _chunks(self, docs: DataFrame) -> DataFrame:
        rows = docs.select("document_id", "source_root_id", "media_type", "recipe", "text")
        w = chunking.chunks(chunking.with_offsets(rows, self.offsets), self.capacity, self.overlap)
        return w.select(
            ids.chunk_id("document_id", "recipe", "ordinal", "chunk_text").alias("chunk_id"), "document_id", "source_root_id", "media_type", "ordinal", F.col("chunk_text").alias("text"), "token_start", "token_end", "byte_start", "byte_end",
            ids.sha256_text("chunk_text").alias("chunk_hash"), F.size(text.tokens("chunk_text")).alias("terms"),
        )

    def _embedded(self, chunks: DataFrame, generation: int) -> DataFrame:
        """Vectors of chunks, in batches of like lengths; where a batch fails, its texts are tried alone, and ``error`` says why one has none.

        Vectors of a wrong size or length are errors too.
        """
        embed, dimensions = self.embed, self.dimensions

        def vector(text: str) -> tuple[list | None, str | None]:
            try:
                (found,) = embed([text])
                return found, None
            except Exception as e:  # noqa: BLE001  a text's failure belongs to its document
                return None, str(e) or type(e).__name__

        def run(batches):
            for batch in batches:
                texts = batch.column("text").to_pylist()
                out: list = [(None, None)] * len(texts)
                for some in batching.packed([len(t) for t in texts], BATCH_ITEMS, BATCH_LETTERS):
                    try:
                        got = [(v, None) for v in embed([texts[i] for i in some])]
                    except Exception:  # noqa: BLE001  the texts of the batch are tried alone
                        got = []
                    for i, x in zip(some, got if len(got) == len(some) else [vector(texts[i]) for i in some]):
                        out[i] = x
                columns = [batch.column("chunk_id"), batch.column("document_id"), pa.array([generation] * len(texts), pa.int64()), pa.array([v for v, _ in out], pa.list_(pa.float32())), pa.array([e for _, e in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "document_id", "generation_id", "embedding", "error"])

        made = chunks.select("chunk_id", "document_id", "text").mapInArrow(run, "chunk_id string, document_id string, generation_id long, embedding array<float>, error string")
        fault = F.when(~vectors.is_unit("embedding", dimensions), F.coalesce("error", F.lit("the vector is not of unit length")))
        return made.withColumn("error", fault)

    def rebuild(self, activate: bool = True) -> int:
        """A shadow generation: only missing vectors are made, and it becomes active once it covers every chunk. A run tells how it went."""
        with self.store.writer():
            now = self.store.current()
            self._must_fit(now, ("chunking",))  # texts are not cut anew
            self._must_fit(now, ("model", "dimensions"), "building")
            building = now.generation("building")
            if building is None:
                building = max([g["id"] for g in now.manifest["generations"]], default=0) + 1
                now = self.store.commit(now.manifest | {"generations": now.manifest["generations"] + [{"id": building, "status": "building"} | self._made_by()], "models": [m for m in now.manifest["models"] if m["id"] != self.model] + [{"id": self.model, "dimensions": self.dimensions}]}, {})
            started = datetime.now(timezone.utc).isoformat()
            entry = {"id": hashlib.sha256(f"{started}{building}".encode()).hexdigest()[:32], "kind": "rebuild", "started_at": started}
            counts, failures = {"chunks": 0, "failed": 0}, []
            self._record(entry | {"status": "running", "counts": counts})
            for root in sorted(now.manifest["roots"]):
                now = self.store.snapshot()
                key = f"{building}/{root}"
                have = now.table("embeddings", [key])
                missing = sync.missing_vectors(now.table("chunks", [root]), have, building)
                made = self._kept(self._embedded(missing, building), "vectors")
                failures += self._failures(made.filter("error is not null").select(F.col("chunk_id").alias("uri"), "error"), counts)[: KEPT_FAILURES - len(failures)]
                good = made.filter("error is null").select("chunk_id", "generation_id", "embedding")
                counts["chunks"] += good.count()
                self.store.commit(now.manifest, {"embeddings": {key: have.unionByName(good)}})
            ended = entry | {"status": "partial" if counts["failed"] else "completed", "finished_at": datetime.now(timezone.utc).isoformat(), "counts": counts}
            self._record(ended, failures)
            if activate:
                self._activate(self.store.snapshot(), building)
        return building

    def drift(self) -> DataFrame:
        """How far the vectors of the generation that is being built are from the active ones, chunk by chunk in one join; see ``evaluate.drift``."""
        now = self.store.current()
        building = now.generation("building")
        if building is None:
            raise StoreError("no generation is being built")
        return evaluate.drift(evaluate.vector_differences(now.active_vectors(), now.vectors(building)))

    def _activate(self, now: Snapshot, generation: int) -> None:
        if not any(g["id"] == generation and g["status"] == "building" for g in now.manifest["generations"]):
            raise StoreError("only a building generation can be activated")
        if sync.missing_vectors(now.table("chunks"), now.vectors(generation), generation).limit(1).count():
            raise StoreError("the generation does not cover all chunks")
        states = [g | {"status": "active" if g["id"] == generation else "retired" if g["status"] == "active" else g["status"]} for g in now.manifest["generations"]]
        retired = {g["id"] for g in states if g["status"] == "retired"}
        drop = {k: None for k in now.manifest["tables"]["embeddings"] if int(k.split("/")[0]) in retired}
        self.store.commit(now.manifest | {"generations": states}, {"embeddings": drop})

    def search(self, query: str, mode: str = "semantic", limit: int = 10, root: str | None = None, media_type: str | None = None, budget: int | None = None) -> DataFrame:
        """Ranked chunks with their documents, sources and the pages or cells they lie in, from one pinned snapshot.

        ``bytes`` runs up what the results hold; a list that passes ``budget`` fails when it is read.
        """
        search.validate_request(query, mode, limit, root, media_type)
        now = self.store.current()
        if now.manifest["generations"]:
            self._must_fit(now, ("model", "dimensions"))
        known = [(k, v["identity"], json.dumps(v.get("metadata") or {}, sort_keys=True)) for k, v in now.manifest["roots"].items()]
        if root is not None and not any(root in one[:2] for one in known) and os.path.exists(root):
            root = "file://" + os.path.realpath(root)  # a local path stands for its root's identity
        roots = self.spark.createDataFrame(known, "id string, identity string, metadata string")
        chunks, live = now.table("chunks"), now.active_vectors()
        scope = search.scoped(chunks, roots, root, media_type)
        ids_in_scope = scope.select("chunk_id")
        rows = live.join(ids_in_scope, "chunk_id", "left_semi")
        depth = search.candidate_limit(mode, limit)
        near = words = None
        if mode != "lexical":
            near = dense.knn(rows, self.embed([self.query_prefix + query])[0], depth) if rows.limit(1).count() else rows.select("chunk_id", F.lit(0.0).alias("distance")).limit(0)
        if mode != "semantic":
            scored = lexical.bm25_indexed(now.live_postings(), *now.text_sums(), lexical.query_phrases(query))
            words = lexical.top(scored.join(rows.select("chunk_id"), "chunk_id", "left_semi"), depth)
        none = F.lit(None).cast("double")
        if mode == "hybrid":
            top = search.fuse(near, words, limit)
        elif mode == "semantic":
            top = search.ranked(near, "distance").withColumn("bm25", none).withColumn("fusion_score", none)
        else:
            top = search.ranked(words, "score").withColumnRenamed("score", "bm25").withColumn("distance", none).withColumn("fusion_score", none)
        docs = now.table("documents").select("document_id", "uri", "metadata")
        sources = roots.select(F.col("id").alias("source_root_id"), F.col("identity").alias("source"), F.col("metadata").alias("source_metadata"))
        full = search.hydrate(top, chunks, docs).join(sources, "source_root_id")
        found = full.withColumn("locations", search.located(F.col("metadata"), F.col("byte_start"), F.col("byte_end")))
        return search.charged(found, budget).orderBy("rank")

    def status(self) -> dict:
        now = self.store.snapshot()
        return {t: now.table(t).count() for t in ("documents", "chunks")} | {"embeddings": now.active_vectors().count(), "roots": len(now.manifest["roots"]), "runs": len(now.manifest["runs"]), "active_generation": now.generation(), "version": now.manifest["version"]}

    def sources(self) -> list[dict]:
        return sorted(({"id": k} | v for k, v in self.store.snapshot().manifest["roots"].items()), key=lambda r: r["identity"])

    def remove(self, source: str) -> int:
        """Drop a root by id or identity with all that belongs to it; an unknown one is no error."""
        with self.store.writer():
            now = self.store.current()
            hit = [k for k, v in now.manifest["roots"].items() if source in (k, v["identity"])]
            for root in hit:
                keys = [k for k in now.manifest["tables"]["embeddings"] if k.endswith(f"/{root}")]
                changes = {"documents": {root: None}, "chunks": {root: None}, "embeddings": dict.fromkeys(keys)}
                for name in ("postings", "removed"):
                    changes[name] = {k: None for k in now.manifest["tables"][name] if k.split("/")[0] == root}
                left = {name: {k: v for k, v in now.manifest[name].items() if k.split("/")[0] != root} for name in ("roots", "sums", "segments")}
                now = self.store.commit(now.manifest | left, changes)
        return len(hit)
