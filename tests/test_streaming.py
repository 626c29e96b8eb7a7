import json

import pytest

from lodestone.streaming import serve


def frame(**more):
    return json.dumps({"v": 1, "id": "1", "op": "search", "query": "words"} | more)


def test_frames():
    assert serve.parse(frame())["op"] == "search" and serve.parse(json.dumps({"v": 1, "id": "2", "op": "cancel", "target": "1"}))
    for bad in ("x", frame(v=2), frame(query=" "), frame(mode="odd"), frame(limit=0), frame(extra=1), frame(root=""), "x" * (serve.MOST_FRAME + 1), json.dumps({"v": 1, "id": "2", "op": "cancel"})):
        with pytest.raises(serve.FrameError):
            serve.parse(bad)


def test_queue_is_fair_and_bounded():
    q = serve.Queue(clients=2, queued=2)
    for client, name in (("a", "1"), ("a", "2"), ("b", "1")):
        assert q.add(client, {"id": name}) is None
    assert q.add("a", {"id": "3"}) == "busy" and q.add("c", {"id": "1"}) == "busy"
    assert q.add("b", {"id": "1"}) == "duplicate_id"
    assert [q.next()[0] for _ in range(3)] == ["a", "b", "a"] and q.next() is None
    assert q.cancel("a", "1") == "interrupt" and q.cancel("a", "9") == "unknown"


def test_stream_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.jsonl").write_text("\n".join([frame(), frame(id="2", limit=0), frame(id="3")]))
    said = []

    def find(query, mode, limit, root, media):
        return spark.createDataFrame([(1, query)], "rank int, text string")

    serve.serve(spark, str(tmp_path / "in"), find, said.extend, str(tmp_path / "cp")).awaitTermination(60)
    kinds = [json.loads(x)["type"] for x in said]
    assert kinds.count("search_result") == 2 and kinds.count("search_completed") == 2 and kinds.count("error") == 1


def test_declarative_validation_agrees(spark):
    lines = [frame(), frame(limit=0), frame(v=2), "junk"]
    got = {r["value"]: r["valid"] for r in serve.valid_frames(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert [got[x] for x in lines] == [True, False, False, False]


ODD = [
    frame(), frame(limit=0), frame(limit=1000), frame(limit=1001), frame(limit=10.5), frame(limit="10"), frame(limit=True), frame(limit=None), frame(v=2), frame(v=True), frame(v="1"), "junk", "[]", "1", "",
    frame(query=""), frame(query=" \t\u00a0\u2003"), frame(query="a\0b"), frame(query=5), frame(query=None), frame(query="x" * 65_536), frame(query="é" * 32_769), frame(query="\x1c"),
    frame(id=""), frame(id="é" * 64), frame(id="é" * 65), frame(id="a\nb"), frame(id="a\x85"), frame(id=7), frame(root=""), frame(root=None), frame(root="r" * 4096), frame(root="r" * 4097), frame(root="a\0"),
    frame(media_type=" "), frame(media_type="text/plain"), frame(media_type=3), frame(mode="odd"), frame(mode="hybrid"), frame(mode=None), frame(extra=1), frame(extra=None), frame(op="other"), frame(op=None),
    json.dumps({"v": 1, "id": "2", "op": "cancel"}), json.dumps({"v": 1, "id": "2", "op": "cancel", "target": "1"}), json.dumps({"v": 1, "id": "2", "op": "cancel", "target": ""}),
    json.dumps({"v": 1, "id": "2", "op": "cancel", "target": "1", "query": "x"}), frame(target="1"), '{"v":1,"id":"1","id":"2","op":"search","query":"q"}', frame()[:-1], frame() + "x", frame() + "]", frame() + "] {}", frame() + "} {", frame() + ',"f":1', frame() + "," + frame(), frame(root="r" * (128 << 10)),
]


def test_both_validators_agree(spark):
    def taken(line):
        try:
            serve.parse(line)
        except serve.FrameError:
            return False
        return True

    rows = spark.createDataFrame(list(enumerate(ODD)), "n int, value string")
    got = dict(serve.valid_frames(rows.select("value")).select("value", "valid").collect())
    assert {x[:200]: got[x] for x in ODD} == {x[:200]: taken(x) for x in ODD}
    assert sum(got.values()) == 9 and None not in got.values()


def test_a_response_above_its_budget_is_one_error(spark, tmp_path):
    from lodestone.operators import search

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.jsonl").write_text("\n".join([frame(), frame(id="2", limit=2)]))
    rows = spark.createDataFrame([(i, "word " * 20) for i in range(1, 4)], "rank int, text string")
    said = []

    def find(query, mode, limit, root, media):
        return search.charged(rows.limit(limit), 250, ("text",))

    serve.serve(spark, str(tmp_path / "in"), find, said.extend, str(tmp_path / "cp")).awaitTermination(60)
    said = [json.loads(x) for x in said]
    assert [(x["id"], x["type"], x.get("code")) for x in said] == [("1", "error", "response_limit")] + [("2", "search_result", None)] * 2 + [("2", "search_completed", None)]
