import pytest
from tokenizers import Tokenizer

from lodestone.llm import counts, words
from test_tokens import texts

PATH = words.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def whole():
    return counts.whole_tokens(PATH)


def test_whole_tokens_are_those_that_the_library_gives_one_token(library, whole):
    """Of all vocabulary strings with a word's end, exactly the proven ones encode alone as their own single id."""
    back = {c: b for b, c in enumerate(words.byte_letters())}
    want = set()
    for name, i in library.get_vocab().items():
        if name.endswith("</w>") and len(name) > 4:
            raw = bytes(back[c] for c in name[:-4])
            text = raw.decode("utf-8", "replace")
            if text.encode() == raw and library.encode(text, add_special_tokens=False).ids == [i]:
                pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
                if len(pieces) == 1 and pieces[0][0] + "</w>" == name:
                    want.add(text)
    assert set(whole) == want and len(whole) == len(want) > 30_000


def test_counts_equal_the_library(library, whole):
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]
    assert counts.Counter(PATH, whole).counts(texts()).tolist() == want
    assert counts.Counter(PATH, []).counts(texts()).tolist() == want  # all merged


def test_rest_is_merged_only(whole, monkeypatch):
    mine, seen = counts.Counter(PATH, whole), []
    ids = mine.merger.ids
    monkeypatch.setattr(mine.merger, "ids", lambda flat, size: (seen.append(bytes(flat).decode()), ids(flat, size))[1])
    assert mine.counts(["the thing is zxqwv, the zxqwv"]).tolist() == [len(Tokenizer.from_file(PATH).encode("the thing is zxqwv, the zxqwv", add_special_tokens=False).ids)]
    assert seen == ["zxqwv"]


def test_long_texts_are_cut_into_stretches(monkeypatch, library, whole):
    long = [" ".join(t.replace("\x00", "") for t in texts()), "", "x" * 90, "a b " * 30 + "I'll 's  "]
    monkeypatch.setattr(words.stretches, "__defaults__", (50,))
    assert counts.Counter(PATH, whole).counts(long).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in long]


def test_awkward_tables(awkward, clashing, empty, library):
    want = []
    for r in awkward.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append(str((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)))
    for docs in (awkward, clashing):
        assert sorted(str(tuple(r)) for r in counts.token_counts(docs).collect()) == sorted(want)
    assert counts.token_counts(empty).count() == 0
    assert counts.token_counts(awkward, limit=1).filter("over_limit").count() == sum(int(w.rsplit(", ", 2)[1]) > 1 for w in want)
