import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx


def plain_sentence(text, size, overlap):
    """Row-by-row statement of the sentence rule."""
    if len(text) <= size:
        return [text.strip(" \t\n\r\x0b\x0c")]
    out, start = [], 0
    while start < len(text):
        if start + size >= len(text):
            out.append(text[start:])
            break
        window = text[start:start + size + 2]
        marks = [(window.rfind(". "), size / 2), (window[:size + 1].rfind("\n"), size / 2), (window[:size + 1].rfind(" "), 1)]
        at = next((p for p, least in marks if p > 0 and p >= least), size)
        at = size if at + 1 - overlap <= 0 else at
        out.append(text[start:start + at + 1])
        start = max(0, start + at + 1 - overlap)
    return [c for c in (c.strip(" \t\n\r\x0b\x0c") for c in out) if c]


def run(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r[0] for r in df.orderBy("id").select(column(F.col("t"))).collect()]


CASES = [
    "", "   ", "short. text", "x" * 1600, "x" * 1601, "a" * 10 + " " + "b" * 3000,
    "a" * 330 + " " + "b" * 5000, "one. " * 700, "line\n" * 900, ("word " * 319 + "end. ") * 3,
    "y" * 1600 + ". " + "z" * 100, "ä" * 4000 + ". end",
]


def test_sentence_chunks_follow_the_rule(spark):
    got = run(spark, CASES, tx.sentence_chunks)
    assert got == [plain_sentence(t, 1600, 320) for t in CASES]


def test_sentence_chunks_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bc", " ", ". ", "\n", "déf"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    got = run(spark, texts, lambda c: tx.sentence_chunks(c, 40, 10))
    assert got == [plain_sentence(t, 40, 10) for t in texts]


def test_slow_steps_reach_the_end(spark):
    # A space just past the overlap moves the start by a few characters only.
    text = ("q" * 11 + " ") * 50
    got = run(spark, [text], lambda c: tx.sentence_chunks(c, 40, 10))[0]
    assert got == plain_sentence(text, 40, 10)
    assert got[-1].endswith("q")


def test_chunks_cover_the_text_beyond_one_slab(spark):
    text = "".join(f"sentence number {i} goes here. " for i in range(6000))
    got = run(spark, [text], tx.sentence_chunks)[0]
    assert got == plain_sentence(text, 1600, 320)
    assert len(text) > 2 * 65536


def test_line_chunks_rebuild_the_text(spark):
    text = "".join(f"row {i}\n" for i in range(3000)) + "z" * 9000
    got = run(spark, [text, "tiny", ""], tx.line_chunks)
    assert "".join(got[0]) == text and max(map(len, got[0])) <= 6001
    assert got[1:] == [["tiny"], [""]]


def test_message_chunks(spark):
    text = "  " + "w" * 6000 + " " + "v" * 6000 + "   tail  "
    got = run(spark, [text, " keep "], tx.message_chunks)
    assert got[0] == ["w" * 6000, "v" * 6000 + "   tail"]
    assert got[1] == [" keep "]


def test_message_chunks_see_trailing_blanks_once(spark):
    text = "a" * 9000 + ". " + "b" * 300 + " " * 400
    assert run(spark, [text], tx.message_chunks)[0] == ["a" * 9000 + ".", "b" * 300]


def test_tokens(spark):
    got = run(spark, ["The Cat, the CAT & a dog-9!"], tx.bm25_tokens)[0]
    assert got == ["cat", "cat", "dog"]
    assert run(spark, ["The a Cat 42"], tx.plain_tokens)[0] == ["the", "cat", "42"]
    assert len(tx.STOP_WORDS) == len(set(tx.STOP_WORDS)) == 110


def test_small_functions(spark):
    def one(column, text):
        return run(spark, [text], column)[0]

    assert one(tx.name_keys, " Anna Lee Bo ") == ["anna lee bo", "anna", "lee"]
    assert one(tx.graph_key, "Big Corp") == "big_corp"
    assert one(tx.repo_container, "My Repo_1") == "repo-my-repo-1"
    assert one(tx.date_from_filename, "2024-01-02-x.md") == "2024-01-02"
    assert one(tx.date_from_filename, "x-2024-01-02") is None
    assert one(tx.is_counting_query, "How MANY books?") is True
    assert one(tx.is_counting_query, "accounts payable") is False
    assert one(tx.clean_subquery_lines, "- one two\n2) abc\n* x\nlast one") == ["one two", "last one"]
    assert one(tx.content_hash, " A b ") == one(tx.content_hash, "a B")
    assert one(tx.valid_container, "a b") is False


@pytest.mark.parametrize("date,want", [("2024-01-01", "[0] [2024-01-01] hi"), (None, "[0] hi"), ("", "[0] hi")])
def test_rerank_line(spark, date, want):
    df = spark.createDataFrame([(0, date, "hi")], "p int, d string, c string")
    assert df.select(tx.rerank_line(F.col("p"), F.col("d"), F.col("c"))).first()[0] == want
