import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, "
    "row long, node long, bin_id string, score double, host string, size long, part long, "
    "digest string, stays long, length long, cluster string, grp long"
)
WORDS = "the a of in and thing other very word list some more less even odd up down left".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


@pytest.fixture
def frame(spark):
    """Rows (doc_id, text, lang, source) with more columns whose names operators use inside."""

    def make(rows):
        full = [
            (d, t, lang, src, len(t or ""), True, 1, 2, "b", 0.5, "h", 3, 4, "x", 5, 6, "c", 7)
            for d, t, lang, src in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, one hot source."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    copy = sentence(rng, 80)
    rows = [
        (1, None, "en", "s1"),
        (2, "", "en", "s1"),
        (3, " \n\t ", None, None),
        (4, copy, "en", "s1"),
        (5, copy, "en", None),
        (6, copy, None, "s2"),
        (6, copy, None, "s2"),
        (None, copy, "en", "s3"),
        (None, None, None, None),
        (7, long, "en", "s1"),
        (8, long + " end", "en", "s1"),
        (9, "12 34 !!", "fr", "s3"),
        (10, "x", "fr", "é"),
    ]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 120)), "en", "hot") for i in range(60)]
    return rows
