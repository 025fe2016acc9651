import random

import pytest
from corpus_texts import words

#: (doc_id, text, lang, source): null ids, texts and sources, empty, blank, repeated, very long, ties, odd spaces.
def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    base = words(rng, 80)
    return [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", "b"), (4, "", None, None),
            (5, " \t\n\x0b\x0c\r ", "de", "b"), (6, "one two", "de", "b"), (None, base + " tail", "en", None), (7, None, None, None),
            (8, words(rng, 30_000), "en", "c"), (9, "x" * 70_000, "fr", "c"), (10, "A  b\n\nC\tD é 漢字   ' 's <|endoftext|> #2",
                                                                             "fr", "a"),
            (11, "word " * 200, "en", "a"), (12, "1234 5678 !!", "en", "a"), (13, base.upper(), "en", "c")]


@pytest.fixture()
def odd_docs(spark):
    rows = [(*r, 7, "clash", True) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, host string, kept boolean")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture()
def make_docs(spark):
    def make(texts, first=0):
        return spark.createDataFrame([(first + i, t, "en", "s") for i, t in enumerate(texts)],
                                     "doc_id long, text string, lang string, source string")
    return make
