"""Search requests as a stream: one JSON object a line in, results out, a fresh snapshot for each batch."""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

MOST_FRAME, MOST_RESPONSE = 128 << 10, 8 << 20
#: Bytes of an id and of a filter; characters an id must not hold; what a query or filter must hold somewhere.
MOST_ID, MOST_FILTER = 128, 4096
CONTROL, VISIBLE = r"[\x00-\x1f\x7f-\x9f]", r"[^\s\x1c-\x1f]"
#: Fields of each operation with their types: needed, and optional ones.
FIELDS = {
    "search": ({"v": int, "id": str, "op": str, "query": str}, {"mode": str, "limit": int, "root": str, "media_type": str}),
    "cancel": ({"v": int, "id": str, "op": str, "target": str}, {}),
}
FILTERS = ("root", "media_type")
FRAME = "v int, id string, op string, query string, mode string, limit int, root string, media_type string, target string"
CLIENTS, QUEUED = 8, 2


class FrameError(Exception):
    """A request that breaks the protocol."""


def _named(x: str) -> bool:
    return 0 < len(x.encode()) <= MOST_ID and not re.search(CONTROL, x)


def _once(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise FrameError("a field comes twice")
    return dict(pairs)


def parse(line: str) -> dict:
    """A request: version 1, an id, and ``search`` with its fields or ``cancel`` with a target; a filter may be null."""
    try:
        if len(line.encode()) > MOST_FRAME:
            raise FrameError("frame too large")
        frame = json.loads(line, object_pairs_hook=_once)
    except (ValueError, RecursionError) as e:
        raise FrameError("not JSON") from e
    op = frame.get("op") if isinstance(frame, dict) else None
    if not isinstance(op, str) or op not in FIELDS:
        raise FrameError("unknown operation")
    needed, optional = FIELDS[op]
    kinds = needed | optional
    if needed.keys() - frame.keys() or frame.keys() - kinds.keys() or any(type(x) is not kinds[k] and not (k in FILTERS and x is None) for k, x in frame.items()):
        raise FrameError("a field is missing, unknown or of a wrong type")
    try:
        if frame["v"] != 1 or not _named(frame["id"]) or op == "cancel" and not _named(frame["target"]):
            raise FrameError(f"a frame has v = 1, and ids of 1 to {MOST_ID} bytes without control characters")
        if op == "search":
            if any(len(frame[k].encode()) > MOST_FILTER for k in FILTERS if frame.get(k) is not None):
                raise FrameError(f"a filter has at most {MOST_FILTER} bytes")
            search.validate_request(frame["query"], frame.get("mode", "semantic"), frame.get("limit", 10), frame.get("root"), frame.get("media_type"))
    except ValueError as e:
        raise FrameError(str(e)) from e
    return frame


class Queue:
    """Requests of several clients: first in, first out for each, in turn between them; full queues and ids in use are refused."""

    def __init__(self, clients: int = CLIENTS, queued: int = QUEUED):
        self.clients, self.queued = clients, queued
        self.waiting: OrderedDict[str, list[dict]] = OrderedDict()
        self.running: dict[tuple[str, str], dict] = {}

    def add(self, client: str, frame: dict) -> str | None:
        """None if it was taken, else why not."""
        mine = self.waiting.get(client, [])
        if client not in self.waiting and len(self.waiting) >= self.clients or len(mine) >= self.queued:
            return "busy"
        if (client, frame["id"]) in self.running or any(f["id"] == frame["id"] for f in mine):
            return "duplicate_id"
        self.waiting.setdefault(client, []).append(frame)
        return None

    def cancel(self, client: str, target: str) -> str:
        mine = self.waiting.get(client, [])
        for f in mine:
            if f["id"] == target:
                mine.remove(f)
                return "cancelled"
        return "interrupt" if (client, target) in self.running else "unknown"

    def next(self) -> tuple[str, dict] | None:
        for client in list(self.waiting):
            frames = self.waiting[client]
            self.waiting.move_to_end(client)
            if frames:
                frame = frames.pop(0)
                self.running[client, frame["id"]] = frame
                return client, frame
        return None

    def done(self, client: str, frame: dict) -> None:
        self.running.pop((client, frame["id"]), None)


def answer(frame: dict, find: Callable[..., DataFrame]) -> list[str]:
    """Result lines of a search and one that closes it; a response above the bound becomes one error."""
    rows = find(frame["query"], frame.get("mode", "semantic"), frame.get("limit", 10), frame.get("root"), frame.get("media_type")).toJSON().collect()  # at most the limit
    lines = [json.dumps({"v": 1, "id": frame["id"], "type": "search_result", **json.loads(r)}) for r in rows]
    lines.append(json.dumps({"v": 1, "id": frame["id"], "type": "search_completed", "results": len(rows)}))
    if sum(len(x.encode()) for x in lines) > MOST_RESPONSE:
        return [json.dumps({"v": 1, "id": frame["id"], "type": "error", "code": "response_too_large"})]
    return lines


def serve(spark: SparkSession, requests: str, find: Callable[..., DataFrame], emit: Callable[[list[str]], None], checkpoint: str, per_trigger: int = 8):
    """A streaming query over a folder of request files; ``find`` is ``Engine.search``, which pins the newest snapshot."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(requests)

    def batch(rows: DataFrame, number: int) -> None:
        queue = Queue(queued=1 << 20)
        for r in rows.select("value").toLocalIterator():
            try:
                frame = parse(r["value"])
            except FrameError as e:
                emit([json.dumps({"v": 1, "type": "error", "code": "invalid_frame", "message": str(e)})])
                continue
            if frame["op"] == "cancel":
                emit([json.dumps({"v": 1, "id": frame["id"], "type": queue.cancel("stream", frame["target"])})])
            elif why := queue.add("stream", frame):
                emit([json.dumps({"v": 1, "id": frame["id"], "type": "error", "code": why})])
        while turn := queue.next():
            client, frame = turn
            spark.addTag(f"request-{frame['id']}")
            try:
                emit(answer(frame, find))
            except Exception as e:  # noqa: BLE001  a failed request must not end the stream
                code = "response_limit" if "response_limit:" in str(e) else "search_failed"
                emit([json.dumps({"v": 1, "id": frame["id"], "type": "error", "code": code, "message": str(e)[:500]})])
            finally:
                spark.removeTag(f"request-{frame['id']}")
                queue.done(client, frame)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def valid_frames(lines: DataFrame) -> DataFrame:
    """The declarative half: request lines parsed and checked without Python, by the rules of ``parse``, for streams and tables alike."""
    # the parser passes over what follows a value; no value but a whole one fits into an array and into an object as well
    whole = [F.try_parse_json(F.concat(F.lit(a), F.col("value"), F.lit(b))) for a, b in (("[", "]"), ('{"f":', "}"))]
    x = lines.select("value", F.from_json("value", FRAME).alias("f"), F.when(whole[0].isNotNull(), whole[1]).alias("_json")).select("value", "f.*", "_json")

    def fields(op: str) -> Column:
        """All fields are known, and of their types."""
        needed, optional = FIELDS[op]
        names = {int: "BIGINT", str: "STRING"}
        kind = {k: F.schema_of_variant(F.try_variant_get("_json", f"$.f.{k}", "variant")) for k in needed | optional}
        ok = F.col("_json").isNotNull() & (F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, needed | optional)))) == 0)
        for k, t in (needed | optional).items():
            ok &= F.coalesce(kind[k] == names[t], F.lit(k in optional)) | (F.lit(k in FILTERS) & F.coalesce(kind[k] == "VOID", F.lit(False)))
        return ok

    def named(c: str) -> Column:
        return F.octet_length(c).between(1, MOST_ID) & ~F.col(c).rlike(CONTROL)

    def shown(c: str, most: int) -> Column:
        return F.col(c).rlike(f"(?U){VISIBLE}") & (F.instr(c, "\0") == 0) & (F.octet_length(c) <= most)

    ask = fields("search") & shown("query", search.MOST_QUERY) & F.coalesce("mode", F.lit("semantic")).isin(*search.MODES) & F.coalesce("limit", F.lit(10)).between(1, 1000)
    for c in FILTERS:
        ask &= F.col(c).isNull() | shown(c, MOST_FILTER)
    ok = (F.col("v") == 1) & named("id") & F.when(F.col("op") == "search", ask).when(F.col("op") == "cancel", fields("cancel") & named("target"))
    return x.withColumn("valid", F.coalesce(ok, F.lit(False)) & (F.octet_length("value") <= MOST_FRAME)).drop("_json")
