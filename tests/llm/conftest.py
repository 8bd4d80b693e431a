import random

import pytest
from made_texts import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, id int, node string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""
    def make(pairs, lang="en"):
        rows = [(i, t, lang, "src0", len(t or ""), "x", 7, "y") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, tiny, long and repeated texts."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, long), (7, "tie"), (7, "tie"), (8, "日本 ñ é"),
            (None, "without id"), (9, "x" * 5000)]
