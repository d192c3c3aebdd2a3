import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; an input may have its own.
CLASHES = {"size": "1", "copies": "'x'", "n": "2", "token": "'t'", "key": "3", "uid": "4", "rep": "5", "label": "6", "t": "'y'", "w": "7", "_rank": "8", "keys": "9", "found": "true", "stratum": "'s'", "pattern": "'p'"}
WORDS = "alpha beta gamma delta omega river stone cloud maple tiger amber violet copper silver ocean meadow winter summer paper candle".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + (r.choice(words) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    base = prose(1, 200)
    long = prose(2, 60_000)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, base + " extra words here", None, "b", None), (4, None, "en", None, 0), (5, "", None, "c", 0),
        (6, " \n\t ", "fr", "c", 4), (7, long, "en", "a", len(long)), (8, "x" * 50_000, "en", "b", None), (9, "one two", "en", "a", 7), (10, "ONE two", "fr", "b", 7),
        (11, prose(3, 120), "fr", "c", 1), (11, prose(3, 120), "fr", "c", 1), (None, prose(4, 80), "en", "a", 1), (None, None, None, None, None), (12, "été\u00a0ça\r\nva 😀 <s>", "fr", "b", 9),
        (13, "1 2 3 4 5 6", "en", "c", 11), (14, "\x00\x1f odd \u2028 spaces", "en", "c", 1), (15, base.upper(), "en", "zzz", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASHES.items()])


@pytest.fixture(scope="session")
def none(nasty):
    return nasty.limit(0)
