import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pii


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }
    return [(k, a, b) for k, spans in found.items() for a, b in spans]


@given(st.lists(st.sampled_from(["a", "@", ".", "-", "_", "é", "1", "255", "256", "+", "(", ")", " ", "4111111111111111", "b.c", "@x.y", "1.2.3.4", "+49 30 1234567", "\n", "٣"]), max_size=40))
@settings(max_examples=400, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute(text)


def test_time_is_linear():
    import time

    for bad in ("a", "a@", "1", "1.", "1 ", "+1", "+1(", "@a.", "a.b@c."):
        began = time.time()
        pii.base_spans(bad * 100_000)
        assert time.time() - began < 5, bad


def test_digests(awkward, clashing, empty):
    want = []
    for r in awkward.collect():
        spans = brute(r["text"] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS]
        want.append(str((r["doc_id"], *counts, hashlib.sha256(written.encode()).hexdigest(), written)))
    for docs in (awkward, clashing):
        assert sorted(str(tuple(r)) for r in pii.digests(docs).collect()) == sorted(want)
    assert pii.digests(empty).count() == 0


def corpus(spark, docs_schema):
    names = "red green blue black white pink grey brown teal gold".split()
    rows = [(i, f"{w} saw Zorblatt of {w} who has x.y@mail.com for {w} things", "en", "a", 0) for i, w in enumerate(names)]
    rows += [(100 + i, f"the {w} things of a day", "en", "a", 0) for i, w in enumerate(names * 9)] + [(300, "<é> Zorblatt, zorblatt again", "en", "a", 0)]
    return spark.createDataFrame(rows + [(1000 + i, "plain words here", "en", "a", 0) for i in range(1000)], docs_schema)


def test_disclosing_terms(spark, docs_schema):
    """One word goes with the address in many contexts and nowhere else; common words near it do not give it away."""
    got = {r["doc_id"]: r["spans"] for r in pii.digests(corpus(spark, docs_schema)).collect() if r["spans"]}
    assert set(got) == {*range(10), 300}
    assert got[300] == "term:4:12,term:14:22"
    assert got[0] == "email:32:44,term:8:16"
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(corpus(spark, docs_schema)).collect()}
    assert clean[300] == "<é> [TERM], [TERM] again" and clean[0] == "red saw [TERM] of red who has [EMAIL] for red things" and clean[1005] == "plain words here"


def test_copies_give_no_contexts(spark, docs_schema):
    docs = spark.createDataFrame([(i, "Zorblatt has x.y@mail.com here", "en", "a", 0) for i in range(50)], docs_schema)
    assert {r["spans"] for r in pii.digests(docs).collect()} == {"email:13:25"}


def test_brute_force_counts(spark, docs_schema):
    """Document counts of terms against a plain count."""
    docs = corpus(spark, docs_schema)
    texts = docs.select(pii.text_key("text").alias("tk"), "text")
    from lodestone.llm.shingles import word_hashes

    names = ["zorblatt", "things", "words"]
    hashes = word_hashes([" ".join(names)])[0].view("int64").tolist()
    got = {r["term"]: r["n_t"] for r in pii.term_documents(texts, spark.createDataFrame([(h,) for h in hashes], "term long")).collect()}
    all_texts = [r["text"].lower() for r in docs.collect()]
    assert [got[h] for h in hashes] == [sum(bool(re.search(rf"\b{n}\b", t)) for t in all_texts) for n in names]


COLOURS = "red green blue black white pink grey brown teal gold".split()


def test_frequent_entities(spark, docs_schema):
    """On a small table an address in a third of all rows, copies among them, is given away by a name, not by common words."""
    rows = [f"{w} asks Zorblatt about {w} at help@mail.com today" for w in COLOURS]
    rows += ["copy asks Zorblatt about copy at help@mail.com today"] * 10
    rows += [f"{w} asks about {w} at home today" for w in COLOURS * 4]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(rows)], docs_schema)
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert got[0] == "red asks [TERM] about red at [EMAIL] today" and got[15] == "copy asks [TERM] about copy at [EMAIL] today"
    assert got[25] == rows[25]


def test_names_far_away_and_short(spark, docs_schema):
    """A name far from the address in most documents, and one of three letters."""
    far = " ".join(["plain words here"] * 6)
    rows = [f"{w} Bob and Zorblatt with {w} x.y@mail.com" for w in COLOURS[:4]] + [f"Zorblatt and Bob {far} {w} x.y@mail.com" for w in COLOURS]
    rows += ["plain words here with and"] * 100 + [f"{w} saw {w} with" for w in COLOURS]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(rows)], docs_schema)
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert got[0] == "red [TERM] and [TERM] with red [EMAIL]" and got[4] == f"[TERM] and [TERM] {far} red [EMAIL]"
    assert got[114] == rows[114] and got[50] == rows[50]
