import datetime as dtm
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts as fa
from tidemark.operators import infer as nf
from tidemark.operators import migrate as mg
from tidemark.plans.scan import carry_last


@pytest.mark.parametrize("bucket", ["day", "hour", "minute"])
def test_as_of(spark, bucket):
    rng = random.Random(8)
    facts = [(1 if i % 3 else 2, dtm.datetime(2024, 1, 1) + dtm.timedelta(minutes=rng.randint(0, 5000)), i, i * 1.5) for i in range(120)]
    asked = [(i, rng.choice([1, 2, 3]), dtm.datetime(2024, 1, 1) + dtm.timedelta(minutes=rng.randint(0, 5000))) for i in range(80)]
    fdf = spark.createDataFrame(facts, "user int, ts timestamp, fact_id int, value double")
    qdf = spark.createDataFrame(asked, "question_id int, user int, ts timestamp")
    got = {r.question_id: (r.fact_id, r.value) for r in fa.as_of(qdf, fdf, ["user"], bucket).collect()}
    for q, user, ts in asked:
        known = [f for f in facts if f[0] == user and f[1] <= ts]
        want = max(known, key=lambda f: (f[1], f[2]))[2:] if known else (None, None)
        assert got[q] == tuple(want)


def test_carry_last(spark, rows):
    df = spark.createDataFrame([("k", i, i if i % 4 == 1 else None) for i in range(10)], "k string, t int, v int")
    got = rows(carry_last(df, ["k"], F.floor(F.col("t") / 3), ["t"], F.col("v"), "last"), "t", "last")
    assert got == [(i, None if i < 1 else 1 if i < 5 else 5 if i < 9 else 9) for i in range(10)]


def brute_profile(facts, mark):
    words = {f: set("".join(c if c.isalnum() else " " for c in t.lower()).split()) for _, f, _, t in facts}
    return sorted(f for u, f, o, _ in facts if not any(
        u == u2 and (o2, f2) > (o, f) and words[f] and words[f2]
        and len(words[f] & words[f2]) >= min(len(words[f]), len(words[f2])) * mark - 1e-9 for u2, f2, o2, _ in facts))


def test_profile_merge(spark):
    rng = random.Random(6)
    vocab = "lives works berlin madrid tea coffee likes owns dog cat".split()
    facts = [(i % 2, i, i, " ".join(rng.sample(vocab, rng.randint(1, 6)))) for i in range(60)]
    facts += [(0, 100 + i, 100 + i, "same words here") for i in range(50)]
    df = spark.createDataFrame(facts, "user_id int, fact_id int, ord int, fact string")
    got = sorted(r.fact_id for r in fa.merge_profile(df).collect())
    assert got == brute_profile(facts, .6)


def test_profile_is_merged_without_the_driver(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)]
    facts = [(0, i, i, " ".join(rng.sample(vocab, rng.randint(1, 6)))) for i in range(80)]
    df = spark.createDataFrame(facts, "user_id int, fact_id int, ord int, fact string")
    # Words of more than three facts are split.
    monkeypatch.setattr(fa, "FACTS_A_PART", 3)
    merged = fa.merge_profile(df)
    assert sorted(r.fact_id for r in merged.collect()) == brute_profile(facts, .6)
    assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()


def test_session_boost(spark, rows):
    hits = spark.createDataFrame([(1, "c", "a", "s1", .5, 1), (1, "c", "b", "s2", .45, 2)],
                                 "query_id int, container string, chunk_id string, session_id string, score double, rank int")
    found = spark.createDataFrame([(1, "c", "s2")], "query_id int, container string, session_id string")
    assert rows(fa.session_boost(hits, found), "chunk_id", "score", "rank") == [("a", .5, 2), ("b", .55, 1)]


def test_infer_batches(spark):
    def fn(frame):
        return pd.DataFrame({"id": frame["id"], "n": [len(frame)] * len(frame)})

    got = nf.infer(spark.range(250).coalesce(1), fn, ["id"], "id long, n long", batch=100).groupBy("n").count().collect()
    assert sorted((r["n"], r["count"]) for r in got) == [(50, 50), (100, 200)]


def test_embed_and_judge(spark, rows):
    df = spark.createDataFrame([(1, "red fox"), (2, ""), (3, "red fox")], "question_id int, t string")
    vectors = {r.question_id: np.array(r.embedding) for r in nf.embed(df, "t").collect()}
    assert np.allclose(vectors[1], vectors[3]) and abs(np.linalg.norm(vectors[1]) - 1) < 1e-5 and not vectors[2].any()

    def fn(frame):
        return pd.DataFrame({"question_id": frame["question_id"], "reply": ['{"score": 1, "label": "correct"}' if t else "?" for t in frame["t"]]})

    assert rows(nf.judge(df, fn, ["question_id", "t"]), "question_id", "score") == [(1, 1), (2, 0), (3, 1)]
    pair = spark.createDataFrame([("Red Fox", "a red, fox!"), ("red fox", "redfox"), ("", "x")], "a string, b string")
    assert [r[0] for r in pair.select(nf.containment_judge(F.col("a"), F.col("b"))).collect()] == [1, 0, 0]


def test_history(spark, rows):
    log = spark.createDataFrame([(1, "m1", "old", "ADD", 1), (2, "m1", "new", "UPDATE", 2), (3, "m1", None, "NOOP", 3), (4, "m2", "gone", "ADD", 1),
                                 (5, "m2", None, "DELETE", 2), (6, "m3", "  ", "ADD", 1), (7, "m4", "new", "ADD", 1)],
                                "row_id int, memory_id string, new_memory string, event string, updated_at int")
    assert rows(mg.compact_history(log)) == [("new", 1)]


def test_union_dedup_prefers_the_first_source(spark, rows):
    a = spark.createDataFrame([(1, "Tea "), (2, "x")], "id int, t string")
    b = spark.createDataFrame([(0, "tea"), (3, "y"), (4, "Y")], "id int, t string")
    assert rows(mg.union_dedup([(0, a), (1, b)], "t", ["id"]), "priority", "id") == [(0, 1), (0, 2), (1, 3)]
