import gzip
import json
import math

import numpy as np
import pytest

from lodestone.__main__ import main
from lodestone.functions import batching
from lodestone.sources import matrices


def events(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


@pytest.mark.parametrize("argv", [[], ["search"], ["search", "x", "--mode", "odd"], ["a", "--chunk-size", "2"], ["a", "--max-file-size", "0"], ["remove"], ["status", "--nope"], ["a", "--overlap", "510"]])
def test_wrong_arguments(argv, capsys):
    assert main(argv) == 2 and events(capsys)[-1]["type"] == "fatal"


def test_cycle(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("alpha beta")
    (tmp_path / "b.bin").write_bytes(b"\0")
    db = ["--db", str(tmp_path / "store"), "--dimensions", "8"]
    assert main([str(tmp_path / "a.txt"), *db], spark) == 0 and events(capsys)[-1]["documents"] == 1
    assert main([str(tmp_path / "*.bin"), *db], spark) == 1
    assert {e["type"] for e in events(capsys)} == {"failed", "completed"}
    assert main(["search", "alpha", "--mode", "hybrid", *db], spark) == 0
    found = events(capsys)
    assert found[0]["type"] == "search_result" and found[0]["text"] == "alpha beta" and found[-1]["results"] == 1
    for command in ("status", "sources", "doctor", "migrate", "rebuild"):
        assert main([command, *db], spark) == 0 and events(capsys)
    assert main(["search", " ", *db], spark) == 2
    assert main(["remove", "nothing", *db], spark) == 0 and events(capsys)[-1]["roots"] == 0


def test_matrices(spark, tmp_path):
    rows = spark.createDataFrame([(2, [0.0, 1.0]), (1, [math.sqrt(0.5)] * 2)], "vec_id long, embedding array<float>")
    m = matrices.write_matrix(rows, str(tmp_path), "documents.f32", "vec_id", "embedding", 2)
    matrices.complete(str(tmp_path), 2, [m])
    got = {r["id"]: r["embedding"] for r in matrices.load(spark, str(tmp_path))["documents.f32"].collect()}
    assert got["2"] == [0.0, 1.0] and set(got) == {"1", "2"}
    with pytest.raises(FileExistsError):
        matrices.complete(str(tmp_path), 2, [m])
    (tmp_path / "documents.f32").write_bytes(b"\0" * 16)
    with pytest.raises(ValueError):
        matrices.load(spark, str(tmp_path))


def test_unpacked(tmp_path):
    with gzip.open(tmp_path / "x.gz", "wb") as f:
        f.write(b'{"a": 1}\n\n{"a": 2}\n')
    assert [x["a"] for x in matrices.unpacked(str(tmp_path / "x.gz"))] == [1, 2]
    with pytest.raises(ValueError):
        list(matrices.unpacked(str(tmp_path / "x.gz"), 10))


def test_packing():
    some = lambda *a: [list(map(int, b)) for b in batching.packed(*a)]
    assert some([10, 30, 90], 9, 100) == [[0, 1], [2]]
    assert some([5, 5], 1, 1) == [[0], [1]] and some([], 4, 10) == []
    assert some([7, 1, 7, 2], 9, 14) == [[1, 3], [0, 2]]


def test_pooling():
    states = np.array([[[3.0, 4.0], [1.0, 0.0], [9.0, 9.0]]], np.float32)
    mask = np.array([[1, 1, 0]])
    assert batching.pooled(states, mask)[0] == pytest.approx([0.6, 0.8])
    assert batching.pooled(states, mask, "mean")[0] == pytest.approx(np.array([2, 2]) / math.sqrt(8))
    with pytest.raises(ValueError):
        batching.pooled(np.zeros((1, 1, 2), np.float32), np.ones((1, 1)))


def test_embedding_keeps_order_and_halves():
    calls = []

    def infer(ids, mask):
        calls.append(len(ids))
        if len(ids) > 2:
            raise MemoryError
        return [[float(m.sum())] for m in mask]

    got = batching.embed_all([[1] * n for n in (5, 1, 4, 2, 3)], infer, 4, 1000, 1)
    assert got.ravel().tolist() == [5, 1, 4, 2, 3] and max(calls) == 4 and min(calls) <= 2


def test_device_choice():
    gb = 1 << 30
    assert batching.choose([{"free": 2 * gb, "total": 8 * gb}, {"free": 6 * gb, "total": 8 * gb}])["free"] == 6 * gb
    assert batching.choose([]) is None and batching.choose([{"free": 0, "total": gb}]) is None
