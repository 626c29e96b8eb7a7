import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark, docs_schema):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows."""
    long_text = " ".join(f"word{i % 977} thing{i % 31}." for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36), (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36), (2, None, None, None, None), (3, "", "de", "b", 0), (4, " \n\t ", "de", "b", 4),
        (5, long_text, "en", "a", len(long_text)), (None, "no id here", "en", "c", 10), (None, None, None, None, None), (6, "Größe 12 à la café İstanbul ΣΑΣ 日本語 é <|endoftext|> x", "de", "ß", 50),
        (7, "one", "en", "a", 3), (8, "one", "en", "a", 3), (9, "x" * 3000 + " " + "!" * 3000, "en", "c", 6001), (10, "mail a.b@c.de or +49 (30) 123-45678 at 10.0.0.1, card 4111 1111 1111 1111.", "en", "c", 80),
    ]
    return spark.createDataFrame(rows, docs_schema)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same with extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = "size target taken slices shard slot label group row score predicted held_out ids decoded tk base terms bands node comp piece rank part start n_tokens query vector word n bucket _text _t _s _b _o _id _key".split()
    return awkward.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
