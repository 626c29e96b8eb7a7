"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give them away.

What the patterns find (addresses, numbers) are the protected entities. For every entity and every word near it the
corpus says how strongly the word reveals the entity: the share of the word's texts that hold the entity, and either the
pointwise mutual information of the two or, for entities too frequent to reach it, the share of the entity's own
information that the word reveals, with contexts enough that chance does not explain it. Words that pass are disclosing
terms; wherever they occur they become spans too, and are generalised with the entities.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import groups, keep, small_batches, text_key, tidy
from .shingles import word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity, different contexts, the share of a term's texts, and bits of mutual information.
NEAR, CONTEXTS, SHARE, BITS = 6, 3, 0.5, 6.0
#: Whatever the entity's frequency: the share of its information that a term reveals, and the evidence in nats, contexts
#: times the divergence of the entity's share among the term's documents from that among all. Copies add none.
REVEALED, EVIDENCE = 0.5, 7.0
#: Shortest term in code points, but for words written like names; bits of the fixed-size filters of candidates.
SHORTEST, MASK_BITS = 4, 20

# The patterns that define the four kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str):
    """Leftmost matches of a local part, an at sign and a dotted domain; each character is looked at a bounded number of times."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def _entity(text: str, kind: int, a: int, b: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{text[a:b]}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def neighbours(text: str, spans):
    """(entity, term, context) hashes of the words near each span; words inside spans are none.

    Near are the NEAR nearest words of SHORTEST code points or more on each side, and as many shorter ones that do not
    begin with a small letter or a digit, as names do. They only propose terms; what is counted is whole documents.
    """
    hashes, _, start, end = word_hashes([text], in_place=True)
    at = _points(np.frombuffer(text.encode("utf-8", "replace") + b" ", np.uint8))
    start, end = at[start], at[end]
    ok = np.ones(len(start), bool)
    for _, a, b in spans:
        ok &= (end <= a) | (start >= b)
    long = ok & (end - start >= SHORTEST)
    name = np.zeros(len(start), bool)
    for i in np.flatnonzero(ok & ~long).tolist():
        first = text[start[i]]
        name[i] = first.isalpha() and not first.islower()
    kinds = [(hashes[x], start[x], end[x]) for x in (long, name)]
    for kind, a, b in spans:
        near = []
        for h, s, e in kinds:
            lo, hi = np.searchsorted(e, a, "right"), np.searchsorted(s, b)
            near += [h[max(0, lo - NEAR) : lo], h[hi : hi + NEAR]]
        near = np.concatenate(near)
        context = int.from_bytes(hashlib.blake2b(near.tobytes(), digest_size=8).digest(), "little", signed=True)
        entity = _entity(text, kind, a, b)
        for term in np.unique(near).view(np.int64).tolist():
            yield entity, term, context


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text key, base spans and the neighbour triples; written to the shared folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tk"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    near_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("entity", "term", "context")]))
    schema = rows.select("doc_id", "tk").schema.add("base", SPAN).add("near", near_type)

    def run(batches):
        for batch in batches:
            base, near = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                base.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
                near.append([{"entity": e, "term": t, "context": c} for e, t, c in neighbours(text, spans)] if spans else [])
            triple = pa.list_(pa.struct([(c, pa.int64()) for c in ("entity", "term", "context")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(base, ARROW_SPAN), pa.array(near, triple)], names=["doc_id", "tk", "base", "near"])

    return keep(rows.mapInArrow(tidy(run), schema).withColumn("row", F.monotonically_increasing_id()), "pii-base")


def _mask(terms: DataFrame) -> np.ndarray | None:
    """A fixed-size filter of term hashes; None if there are no terms. At most 2**MASK_BITS numbers reach the driver."""
    spots = terms.select(F.shiftrightunsigned("term", 64 - MASK_BITS).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()
    if not len(spots):
        return None
    mask = np.zeros(1 << MASK_BITS, bool)
    mask[spots] = True
    return np.packbits(mask)


def _hits(part: list[str], mask: np.ndarray):
    """Words of the texts that pass the filter: hashes, their texts' numbers, byte offsets."""
    hashes, per, start, end = word_hashes(part, in_place=True)
    hit = np.flatnonzero(mask[(hashes >> np.uint64(64 - MASK_BITS)).astype(np.int64)])
    return hashes[hit], np.searchsorted(np.cumsum(per), hit, "right"), start[hit], end[hit]


def term_documents(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t): documents that hold each term, over all documents; counted in the tasks before they are shuffled."""
    packed = _mask(terms)
    if packed is None:
        return texts.sparkSession.createDataFrame([], "term long, n_t long")
    sent = texts.sparkSession.sparkContext.broadcast(packed.tobytes())

    def run(batches):
        mask = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        seen: dict[int, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for part in groups(batch.column("text").to_pylist()):
                hashes, owner, _, _ = _hits(part, mask)
                pairs = np.unique(np.stack([hashes.view(np.int64), owner]), axis=1)
                for term, n in zip(*(x.tolist() for x in np.unique(pairs[0], return_counts=True))):
                    seen[term] = seen.get(term, 0) + n
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        yield out()

    return texts.select("text").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def pair_documents(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity, term, n_te): documents that hold both, wherever in them, for the given pairs; over all documents."""
    packed, mixed = _mask(pairs.select("term").distinct()), _mask(pairs.select(F.expr("entity ^ term").alias("term")))
    schema = "entity long, term long, n long"
    if packed is None:
        return texts.sparkSession.createDataFrame([], "entity long, term long, n_te long")
    sent = texts.sparkSession.sparkContext.broadcast((packed.tobytes(), mixed.tobytes()))

    def run(batches):
        mask, both = (np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in sent.value)
        seen: dict[tuple[int, int], int] = {}

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["entity", "term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                if not spans:
                    continue
                terms = np.unique(_hits([text], mask)[0])
                for entity in {_entity(text, *x) for x in spans}:
                    mix = terms ^ np.array([entity], np.int64).view(np.uint64)
                    for term in terms[both[(mix >> np.uint64(64 - MASK_BITS)).astype(np.int64)]].view(np.int64).tolist():
                        seen[entity, term] = seen.get((entity, term), 0) + 1
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        yield out()

    counted = texts.select("text").mapInArrow(tidy(run), schema).groupBy("entity", "term").agg(F.sum("n").alias("n_te"))
    return counted.join(pairs.select("entity", "term"), ["entity", "term"], "left_semi")


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(tk, start, end) of all words of all texts that are one of the terms, in code points."""
    packed = _mask(terms)
    if packed is None:
        return texts.sparkSession.createDataFrame([], "tk binary, start long, end long")
    sent = texts.sparkSession.sparkContext.broadcast(packed.tobytes())

    def run(batches):
        mask = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            keys, at_row = batch.column("tk").to_pylist(), 0
            for part in groups(batch.column("text").to_pylist()):
                hashes, owner, start, end = _hits(part, mask)
                before = _points(np.frombuffer(b" ".join(t.encode("utf-8", "replace") for t in part) + b" ", np.uint8))
                first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])[owner]
                rows = [keys[at_row + o] for o in owner.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(hashes.view(np.int64)), pa.array(before[start] - first), pa.array(before[end] - first)], names=["tk", "term", "start", "end"])
                at_row += len(part)

    return texts.mapInArrow(tidy(run), "tk binary, term long, start long, end long").join(terms, "term", "left_semi").select("tk", "start", "end").distinct()


def _discloses(n: float):
    """Whether n_te, n_t, n_e and contexts make a term of ``n`` documents a disclosing one."""
    share, own = F.col("n_te") / F.col("n_t"), F.col("n_e") / F.lit(n)
    bits = F.log2(share / own)
    revealed = F.when(own < 1, bits / -F.log2(own))  # 1 where the term's documents all hold the entity
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - own))).otherwise(0.0)
    evidence = F.col("contexts") * (share * F.log(share / own) + rest)
    return (share >= SHARE) & ((bits >= BITS) | F.coalesce((revealed >= REVEALED) & (evidence >= EVIDENCE), F.lit(False)))


def disclosing(docs: DataFrame, base: DataFrame, text_col: str) -> DataFrame:
    """(tk, terms): the spans of disclosing terms in every text that holds one.

    All counts are of documents, over all of them; copies of a text count, but give no new contexts.
    """
    near = base.select("row", F.explode("near").alias("x")).select("row", "x.*")
    held = near.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    # a document counts once; contexts are counted before they meet, so that no entity or term gathers rows
    per = near.groupBy("entity", "term", "row").agg(F.min("context").alias("context")).select("entity", "term", "context").distinct()
    likely = per.groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= CONTEXTS)
    likely = keep(likely.join(held, "entity"), "pii-likely")
    texts = docs.select(text_key(text_col).alias("tk"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_t = term_documents(texts, likely.select("term"))
    n_te = pair_documents(texts, likely)
    bad = keep(likely.join(n_te, ["entity", "term"]).join(n_t, "term").filter(_discloses(float(base.count()))).select("term").distinct(), "pii-terms")
    spans = occurrences(texts, bad).select("tk", F.struct(F.lit("term").alias("kind"), "start", "end").alias("x"))
    return keep(spans.groupBy("tk").agg(F.sort_array(F.collect_list("x")).alias("terms")).select("tk", F.col("terms").cast(SPAN)), "pii-disclosing")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, base (spans of the patterns) and terms (spans of disclosing terms), code points, end exclusive.

    Defined cases: a null text is empty and has no spans; equal texts have equal spans; repeated rows and null or
    repeated ids are rows of their own; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = found(docs, id_col, text_col)
    terms = disclosing(docs, base, text_col)
    return base.select("doc_id", "tk", "base").join(terms, "tk", "left").select("doc_id", "base", F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find`` as counts per kind, a digest of the base spans and all spans written out."""
    rows = find(docs, id_col, text_col)

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "terms")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in brackets; where spans overlap, the earlier and longer one counts."""
    small_batches(docs.sparkSession)
    base = found(docs, id_col, text_col)
    terms = disclosing(docs, base, text_col).select(F.col("tk").alias("__ls_tk"), F.col("terms").alias("__ls_terms"))
    rows = docs.withColumn("__ls_key", text_key(text_col)).join(terms, F.col("__ls_key") == F.col("__ls_tk"), "left").drop("__ls_key", "__ls_tk")
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for text, extra in zip(batch.column(text_col).to_pylist(), batch.column("__ls_terms").to_pylist()):
                spans = [(a, -b, KINDS[k]) for k, a, b in base_spans(text)] if text else []
                spans += [(x["start"], -x["end"], x["kind"]) for x in extra or []]
                if spans:
                    parts, done = [], 0
                    for a, b, kind in sorted(spans):
                        if a >= done:
                            parts += [text[done:a], f"[{kind.upper()}]"]
                            done = -b
                    text = "".join(parts) + text[done:]
                out.append(text)
            arrays = [batch.column(c) for c in names]
            arrays[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.select(*names, "__ls_terms").mapInArrow(tidy(run), docs.schema)
