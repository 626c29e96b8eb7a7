"""Slices of Arrow batches: bounded, whole, in order; what is made by slices is what is made at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import slices
from lodestone.operators import chunking, lexical
from lodestone.plans.engine import word_offsets


def test_slices_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["abc", None, "", "x" * 50, "ab", "ab", "a"])})
    got = list(slices.bounded([batch, batch.slice(0, 0)], slices.of_text("t"), 4))
    assert [b.column("t").to_pylist() for b in got] == [["abc", None, ""], ["x" * 50], ["ab", "ab"], ["a"]]


def test_no_worker_meets_more_than_a_slice(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 9 == 4 else " ".join(f"w{(i * j) % 7}é" for j in range(i % 13))) for i in range(60)], "chunk_id long, text string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def offsets(text):
        return word_offsets(text)

    def both():
        made = chunking.with_offsets(rows, offsets).select("chunk_id", F.to_json("offsets").alias("o")).collect()
        posted = lexical.postings(rows).select("term", "chunk_id", "dl", "tf", "positions").collect()
        return sorted(map(tuple, made)), sorted((t, c, d, f, tuple(p)) for t, c, d, f, p in posted)

    whole = both()
    monkeypatch.setattr(slices, "TEXT_BYTES", 40)
    monkeypatch.setattr(slices, "TOKENS", 9)
    # workers import the module anew, so the limits are set there too
    made = rows.select("chunk_id", "text")

    def small(batches):
        from lodestone.functions import slices as own

        for b in own.bounded(batches, own.of_text("text"), 40):
            seen.add(1)
            yield b

    assert made.mapInArrow(small, made.schema).count() == 60 and seen.value > 10
    assert both() == whole and len(whole[0]) == 60
    want = sorted((t, i) for i, x in made.collect() if x for t in set(x.replace("é", "e").split()))
    assert sorted((t, c) for t, c, *_ in whole[1]) == want


def test_postings_in_order_are_the_same_rows_by_term(spark):
    texts = [None, "", "b a b", "Ä c", "a " * 40] + [" ".join(f"w{(i * j) % 7}" for j in range(i % 13)) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    made = lexical.postings_in_order(rows)
    assert made.schema.simpleString() == lexical.postings(rows).schema.simpleString()
    assert sorted(map(str, made.collect())) == sorted(map(str, lexical.postings(rows).collect()))
    for part in made.rdd.map(lambda r: r["term"]).glom().collect():
        assert part == sorted(part)
