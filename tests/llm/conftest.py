import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, hash int, score double, _row string, lang_pred string, fingerprint int"


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, len(text or ""), "x", 1, 0.5, "r", "zz", 7)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, repeated rows, empty, blank and very long texts, ties, and extra columns with names that operators use."""
    long_ = prose(30_000, 1)
    rows = [row(1, "Hello World, hello!"), row(2, "hello world, HELLO!"), row(2, "hello world, HELLO!"), row(3, None), row(4, ""), row(5, " \t\n "), row(6, long_), row(7, long_ + " end"), row(None, "orphan text of nobody"), row(8, None, None, None), row(9, prose(60, 2), "fr", None), row(10, "intro " + prose(60, 2) + " outro", None), row(11, "12345 !!! ???"), row(12, "Ünïcode É test “quoted” 日本語   x  y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
