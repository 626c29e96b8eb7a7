import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe, pfor, words
from lodestone.llm.lexicon import Lexicon, build

PATH = words.default_vocabulary()
ODD = ["", " ", "It's 3.5, isn't IT?", "a'.b ,.,. _x_ don't!!", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ıI ŉ ſ", "é     x", "<|endoftext|>mid<|startoftext|>", "日本語のテキスト", "x" * 500, "!" * 200 + "a" * 99, "½² ١٢٣ Ⅷ", "a\x85b\x1cc\x00d", "🙂👍🏽 ok"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.integers(0, 70_000), max_size=700), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(ids, far):
    x = np.array(ids + [2**32 - 1 - i for i in range(far)], np.uint32)
    blob = pfor.pack(x)
    assert pfor.unpack(blob).tolist() == x.tolist()
    a, b = len(x) // 3, len(x) // 2
    assert pfor.unpack(blob, a, b).tolist() == x[a:b].tolist()


def test_pack_puts_outliers_aside():
    x = np.arange(128, dtype=np.uint32) % 16
    x[5] = 60_000
    assert len(pfor.pack(x)) < 128  # four bits an id and one exception


def texts():
    rng = random.Random(3)
    base = ODD + [" ".join(rng.choice(["The", "thing,", "Größe", "stupid.", "l'eau", "niño", "x1y2", "--", "\n"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    return base + ["".join(rng.choice("abcXYZ éßñ0123'.,!\n\t_") for _ in range(rng.randrange(80))) for _ in range(200)]


def test_library_words_equal_the_library(library):
    got = words.LibraryWords(PATH).encode(texts())
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts()]


def test_encoder_equals_the_library(library):
    lexicon = Lexicon.mapped(bpe.compile_lexicon(["the", "thing", "größe", "stupid", "eau"], PATH))
    got = bpe.Encoder(PATH, lexicon).written(texts())
    for t, (ids, decoded) in zip(texts(), got):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(alphabet="abcdeinrst", max_size=60), max_size=20))
@settings(max_examples=40, deadline=None)
def test_words_merge_alike_together_and_alone(found):
    m = bpe.Merger(PATH)
    library = Tokenizer.from_file(PATH)
    flat, size = np.frombuffer("".join(found).encode(), np.uint8), np.array([len(w) for w in found], np.int64)
    ids, count = m.ids(flat, size)
    ends = np.cumsum(count)
    for w, e, n in zip(found, ends.tolist(), count.tolist()):
        part = m.first[np.frombuffer(w.encode(), np.uint8)]
        if w:
            part[-1] = m.last[ord(w[-1])]
        want = library.encode(w, add_special_tokens=False).ids
        assert ids[e - n : e].tolist() == want and m.merged_alone(part).tolist() == want


def test_long_texts_are_cut_into_stretches(monkeypatch, library):
    long = [" ".join(t.replace("\x00", "") for t in texts()), "", "x" * 90, "a b " * 30 + "I'll 's  "]
    lexicon = Lexicon.mapped(bpe.compile_lexicon(["the", "thing"], PATH))
    monkeypatch.setattr(words.stretches, "__defaults__", (50,))
    plain = [t for t in long if words.Splitter(PATH).plain(t)] + [" ".join(t for t in texts() if words.Splitter(PATH).plain(t))]
    assert sum(1 for _ in words.stretches(plain)) > 20
    for t, (ids, decoded), one, n in zip(plain, bpe.Encoder(PATH, lexicon).written(plain), words.LibraryWords(PATH).encode(plain), bpe._digests(bpe.Encoder(PATH, lexicon), plain)[0].to_pylist()):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == library.decode(want, skip_special_tokens=False) and one.tolist() == want and n == len(want)
    sums = bpe._digests(bpe.Encoder(PATH, lexicon), plain)
    assert sums[1].to_pylist() == [hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for t in plain]


@given(st.dictionaries(st.binary(min_size=0, max_size=9), st.lists(st.integers(0, 9), max_size=4), max_size=40), st.lists(st.binary(max_size=9), max_size=20))
@settings(max_examples=80, deadline=None)
def test_lexicon_finds_what_it_holds(entries, others):
    lexicon = Lexicon.mapped(build(entries))
    asked = list(entries) + others
    assert lexicon.find(asked) == [entries.get(w) for w in asked]


def test_lexicon_shares_suffixes():
    few = build({(p + "tion").encode(): [1] for p in "abc"})
    assert len(Lexicon(few).final) == 6  # the start, one state after the first letters, four for the ending


def test_segments_and_documents(spark, awkward, clashing, empty, library):
    rows = sorted(awkward.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode())))
    want, start = [], 0
    for r in rows:
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for docs in (awkward, clashing):
        segments = pfor.write_segments(docs, segment_ids=500)
        assert segments.count() > 3
        assert sorted(map(tuple, pfor.read_documents(segments).collect()), key=lambda r: r[1]) == want
    assert pfor.read_documents(pfor.write_segments(empty)).count() == 0


def test_equal_rows_are_dealt_to_several_parts(spark, docs_schema, library):
    docs = spark.createDataFrame([(5, "the same", "en", "a", 0)] * 90 + [(i, f"text {i}", "en", "a", 0) for i in range(40)], docs_schema)
    segments = pfor.write_segments(docs)
    assert segments.select("part").distinct().count() >= 4
    got = sorted(map(tuple, pfor.read_documents(segments).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([5] * 90 + [*range(40)]) and [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()


def test_bpe_digests(awkward, clashing, empty, library):
    want = []
    for r in awkward.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append(str((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in bpe.digests(awkward).collect()) == sorted(want)
    assert sorted(str(tuple(r)) for r in bpe.digests(clashing).collect()) == sorted(want)
    assert bpe.digests(empty).count() == 0
    full = bpe.encode(awkward).filter("doc_id = 6").first()
    assert full["ids"] == library.encode(awkward.filter("doc_id = 6").first()["text"], add_special_tokens=False).ids and full["decoded"]
