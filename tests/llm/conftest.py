import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "did long, th int, data string, words int, sig string, label int, kept boolean, rank int, taken string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(5)
    base, passage = sentence(rng, 300), sentence(rng, 70)
    lines = "\n".join(sentence(rng, 12) for _ in range(6))
    words = base.split()
    words[150] = "changed"
    rows = [
        (None, base, "en", None, None),
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n \r\x0b\x0c", "en", "b", 5),
        (4, base, "en", "b", len(base)),
        (4, base, "en", "b", len(base)),
        (5, " ".join(words), "en", "a", -3),
        (6, sentence(rng, 40) + " " + passage + " " + sentence(rng, 40), "de", "c", 1),
        (7, sentence(rng, 20) + " " + passage + " " + sentence(rng, 60), "de", "c", 1),
        (8, lines, "fr", None, 2),
        (9, lines + "\n\n" + lines, "fr", "c", 2),
        (10, sentence(rng, 6_000), "en", "a", 9),
        (11, "ab " * 400, "en", "a", 9),
        (12, "one two three", "en", "b", 9),
        (13, "one two three", "en", "b", 9),
        (14, "Licensed under the MIT license. The MIT License applies, Apache-License too.", "en", "b", 9),
        (14, sentence(rng, 120), "en", "b", 9),
        (15, "你好 <|endoftext|> \U0001f600 x" * 3, "zh", "é", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows beside columns that clash with names used inside."""
    rows = [(*r, i, i, "x", i, "y", i % 2, True, i, "z") for i, r in enumerate(odd_rows())]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {CLASH}")


@pytest.fixture
def docs(spark):
    def make(*texts, first=0):
        rows = [(first + i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def labels(spark):
    def make(*rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
