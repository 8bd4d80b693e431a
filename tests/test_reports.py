import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare as cp
from tidemark.operators import filters as fl
from tidemark.operators import metrics as mt
from tidemark.operators import report as rp
from tidemark.operators import runs as rn
from tidemark.operators import sampling as sm
from tidemark.plans.ranks import bucketed_row_number
from tidemark.plans.skew import top_k


def test_retrieval_metrics(spark):
    hits = [(1, f"d{i}", i) for i in range(1, 13)] + [(2, f"d{i}", i) for i in range(1, 4)]
    labels = [(1, "d1", 1), (1, "d10", 1), (1, "d11", 1), (1, "d2", 2), (2, "d9", 1)]
    out = mt.retrieval_metrics(
        spark.createDataFrame([(1,), (2,), (3,)], "query_id int"), spark.createDataFrame(hits, "query_id int, chunk_id string, rank int"),
        spark.createDataFrame(labels, "query_id int, chunk_id string, relevant int"), 10,
        spark.createDataFrame([(1, 4), (2, 1)], "query_id int, n_relevant int"))
    got = {r.query_id: r.asDict() for r in out.collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[1] == dict(query_id=1, hit_at_k=1, precision_at_k=.2, recall_at_k_ref=1, f1_at_k=round(.4 / 1.2, 6), mrr=1, k=10,
                          ndcg=round((1 + 1 / math.log2(11)) / ideal, 6), relevant_retrieved=2, total_relevant=2, recall_at_k=.5)
    assert (got[2]["k"], got[2]["mrr"], got[2]["ndcg"], got[2]["total_relevant"]) == (3, 0, 0, 1)
    assert (got[3]["k"], got[3]["precision_at_k"], got[3]["total_relevant"]) == (0, 0, 1)
    means = mt.retrieval_means(out).first()
    assert means.k == 0 and means.n == 3 and means.hit_at_k == round(1 / 3, 6)
    assert mt.retrieval_means(out.where("query_id > 9")).count() == 0


def brute_latency(values):
    v = sorted(x for x in values if x > 0)
    n = len(v)
    return (v[0], v[-1], math.floor(statistics.fmean(v) + .5), v[n // 2], v[math.floor(n * .95)], v[math.floor(n * .99)],
            math.floor(statistics.pstdev(v) + .5), n)


def test_latency_stats(spark):
    rng = random.Random(1)
    groups = {
        "one": [7], "two": [3, 9], "twenty": list(range(20, 0, -1)), "hundred": list(range(1, 101)),
        "hot": [5] * 3000 + [0] * 50 + [rng.randint(1, 10**6) for _ in range(500)],
        "wide": [rng.randint(1, 2**40) for _ in range(200)] + [-4],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v bigint")
    got = {r[0]: tuple(r)[1:] for r in rp.latency_stats(df, "v", ["g"]).collect()}
    assert got == {g: brute_latency(vs) for g, vs in groups.items()}
    names = spark.createDataFrame([("one",), ("none",)], "g string")
    filled = {r[0]: tuple(r)[1:] for r in rp.latency_stats(df, "v", ["g"], names).collect()}
    assert filled == {"one": brute_latency([7]), "none": (0,) * 8}


def test_accuracy_rollup(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "question_type string, score int")
    assert rows(rp.accuracy_by_type(df)) == [("(all)", 3, 2, .666667), ("a", 2, 1, .5), ("b", 1, 1, 1.0)]


def test_bucketed_row_number_equals_a_sort(spark):
    rng = random.Random(4)
    data = [(i, round(rng.choice([0.0, 0.0, 0.0, rng.random()]), 4)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, accuracy double")
    got = [r.id for r in cp.leaderboard_rank(df, id_block=40).orderBy("rank").collect()]
    assert got == [i for i, _ in sorted(data, key=lambda p: (-p[1], p[0]))]
    plain = bucketed_row_number(df, [F.col("id")], {"_b": F.floor(F.col("id") / 7)}, [F.col("_b")]).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in plain] == [(i, i + 1) for i in range(500)]


def test_top_k_with_salts(spark, rows):
    df = spark.createDataFrame([("hot", i) for i in range(3000)] + [("cold", 1)], "g string, v int")
    got = rows(top_k(df, ["g"], [F.col("v").desc()], 1500, spread="v"))
    assert len(got) == 1501 and ("hot", 2999, 1) in got and ("hot", 1500, 1500) in got


PHASES = ["ingest", "indexing", "search", "answer", "evaluate"]


def log(spark, data):
    rows = [(run, q, p, s, 10 * (i + 1)) for (run, q), states in data.items() for i, (p, s) in enumerate(zip(PHASES, states))]
    return spark.createDataFrame(rows, "run_id string, question_id string, phase string, status string, duration_ms bigint")


C, P, X = "completed", "pending", "failed"


def test_run_status_order(spark, rows):
    phases = log(spark, {
        ("active", "q"): [X] * 5, ("stored", "q"): [X] * 5, ("broken", "q"): [C, C, X, P, P], ("full", "q"): [C] * 5,
        ("half", "q"): [C, P, P, P, P], ("idle", "q"): [P] * 5, ("run", "q"): [P] * 5,
    })
    runs = spark.createDataFrame([("active", "running"), ("stored", "completed"), ("broken", "running"), ("full", "running"),
                                  ("half", "initializing"), ("idle", "initializing"), ("run", "running"), ("none", "initializing")],
                                 "run_id string, status string")
    active = spark.createDataFrame([("active", "stopping")], "run_id string, active_status string")
    assert dict(rows(rn.run_status(runs, phases, active))) == {
        "active": "stopping", "stored": "completed", "broken": "failed", "full": "completed", "half": "partial", "idle": "pending",
        "run": "partial", "none": "pending"}


def test_compare_status(spark, rows):
    members = spark.createDataFrame([("a", C), ("a", C), ("b", C), ("b", X), ("c", "running"), ("c", X), ("d", C), ("d", "partial"), ("e", C)],
                                    "compare_id string, run_status string")
    state = spark.createDataFrame([("e", "stopping")], "compare_id string, state string")
    assert dict(rows(rn.compare_status(members, state))) == {"a": C, "b": X, "c": "running", "d": "partial", "e": "stopping"}


def test_funnel_pending_and_fork(spark, rows):
    phases = log(spark, {("r", "q1"): [C, C, C, P, P], ("r", "q2"): [C, P, P, P, P], ("s", "q1"): [C] * 5})
    assert rows(rn.phase_funnel(phases)) == [("r", 2, 2, 1, 1, 0, 0), ("s", 1, 1, 1, 1, 1, 1)]
    targets = phases.select("run_id", "question_id").distinct()
    assert rows(rn.pending_work(targets, phases, "answer")) == [("r", "q1")]
    assert rows(rn.pending_work(targets, phases, "indexing")) == [("r", "q2")]
    assert rn.pending_work(targets, phases, "answer", targets.where("question_id = 'q2'")).count() == 0
    runs = spark.createDataFrame([("s", None, C, "j1"), ("t", "base", C, "j1")], "run_id string, data_source_run_id string, status string, judge string")
    row, copied = rn.fork_run(runs, phases, "s", "n", "answer", judge="j2")
    assert rows(row) == [("n", "s", "running", "j2")]
    assert rows(copied, "phase", "status", "duration_ms") == [
        ("answer", P, None), ("evaluate", P, None), ("indexing", C, 20), ("ingest", C, 10), ("search", C, 30)]
    assert rows(rn.fork_run(runs, phases, "t", "n", "search")[0]) == [("n", "base", "running", "j1")]


def test_report(spark, rows):
    phases = log(spark, {("r", "q1"): [C] * 5, ("r", "q2"): [C] * 5, ("r", "q3"): [C, C, C, C, P]})
    questions = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "a")], "question_id string, question_type string")
    results = spark.createDataFrame([("r", "q1", 1)], "run_id string, question_id string, score int")
    summary, by_type, latency = rp.report(questions, phases, results)
    assert rows(summary) == [("r", 2, 1, .5)]
    assert rows(by_type) == [("r", "a", 1, 1, 1.0), ("r", "b", 1, 0, 0.0)]
    assert ("r", "total", 150, 150, 150, 150, 150, 150, 0, 2) in rows(latency)


def test_filters(spark, rows):
    df = spark.createDataFrame([("Alpha", C), ("beta", X), ("ALTO", None), (None, P)], "name string, status string")
    assert rows(fl.filter_rows(df, search="AL", search_cols=["name"]), "name") == [("ALTO",), ("Alpha",)]
    assert rows(fl.filter_rows(df, status="pending"), "name") == [("ALTO",), (None,)]
    assert fl.filter_rows(df, status="whatever", isin={"name": []}, limit=0).count() == 4
    assert rows(fl.filter_rows(df, order=["name"], offset=1, limit=2), "name") == [("ALTO",), ("Alpha",)]
    page = fl.page(df.select("name"), [F.col("name").desc_nulls_last()], 2, 3).collect()
    assert [tuple(r) for r in page] == [(None, 4, 2)]
    assert (("status", C, 1)) in rows(fl.facet_counts(df, ["status", "name"]))


def test_board(spark, rows):
    schema = "provider string, benchmark string, version string, run_id string, added_at int, accuracy double"
    old = spark.createDataFrame([("p", "b", "v", "r1", 9, .1), ("p", "b", "w", "r2", 1, .2)], schema)
    new = spark.createDataFrame([("p", "b", "v", "r3", 2, .3), ("p", "b", "v", "r4", 3, .4)], schema)
    assert rows(cp.leaderboard_upsert(old, new), "version", "run_id") == [("v", "r4"), ("w", "r2")]
    runs = spark.createDataFrame([("r1", "p", "b", "  "), ("r2", "p", "b", " x ")], "run_id string, provider string, benchmark string, version string")
    results = spark.createDataFrame([("r1", True, 1), ("r1", True, 0), ("r2", False, 1)], "run_id string, evaluated boolean, score int")
    assert rows(cp.leaderboard_entries(runs, results), "run_id", "version", "accuracy") == [("r1", "baseline", .5)]


def test_pivot_and_winners(spark, rows):
    data = spark.createDataFrame([("t1", "a", 1, .5), ("t1", "b", 2, .5), ("t2", "b", 2, .1)], "question_type string, provider string, ord int, accuracy double")
    assert rows(cp.provider_pivot(data, ["a", "b"])) == [("t1", .5, .5, "a"), ("t2", None, .1, "b")]
    summary = spark.createDataFrame([("c", "a", 1, .5), ("c", "b", 2, .5)], "compare_id string, provider string, ord int, accuracy double")
    latency = spark.createDataFrame([("c", "a", 1, "search", 7), ("c", "b", 2, "search", 7), ("c", "b", 2, "answer", 3), ("c", "a", 1, "answer", 4)],
                                    "compare_id string, provider string, ord int, phase string, mean int")
    assert rows(cp.winners(summary, latency)) == [("c", "accuracy", "a", True), ("c", "answer", "b", True), ("c", "search", "a", True), ("c", "search", "b", False)]


@pytest.mark.parametrize("seed", [None, 3])
def test_sampling(spark, seed):
    df = spark.createDataFrame([(f"q{i}", "ab"[i % 2], i) for i in range(20)], "question_id string, question_type string, pos int")
    got = sm.sample_questions(df, "sample", per_category=3, seed=seed).collect()
    assert len(got) == 6
    assert sorted(r.pos for r in got) == [0, 1, 2, 3, 4, 5] or seed is not None
    assert sorted(sm.sample_questions(df, "sample", per_category=3, seed=seed).collect()) == sorted(got)
    assert sm.sample_questions(df, "limit", limit=4).count() == 4 and sm.sample_questions(df).count() == 20
