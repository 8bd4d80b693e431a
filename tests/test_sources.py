import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import index as ix
from tidemark.sources import datasets as ds
from tidemark.sources import tables as tb


def put(path, doc):
    path.write_text(json.dumps(doc))
    return str(path)


def test_positional_sessions(spark, rows, tmp_path):
    talk = [{"role": "user", "content": "hi", "has_answer": True}, {"role": "assistant", "content": "yo"}]
    put(tmp_path / "b.json", {"question_id": "q2", "question": "?", "answer": "7", "question_type": "t", "question_date": "2023/05/08 (Mon) 01:00",
                              "haystack_dates": ["2023/05/01 (Mon) 13:00", "bad"], "haystack_sessions": [talk, talk[:1]]})
    put(tmp_path / "a.json", {"question_id": "q1", "question": "!", "answer": 5, "question_type": "t", "question_date": "someday",
                              "haystack_dates": [], "haystack_sessions": [talk]})
    put(tmp_path / "c.json", {"question": "no id", "haystack_sessions": []})
    data = ds.load_positional_sessions(spark, str(tmp_path))
    assert rows(data.sessions) == [("q1-session-0", None, None), ("q2-session-0", "2023-05-01T13:00:00.000Z", "1:00 pm on 1 May, 2023"), ("q2-session-1", None, None)]
    assert rows(data.questions, "question_id", "ground_truth", "question_date") == [("q1", "5", "someday"), ("q2", "7", "2023-05-08T01:00:00.000Z")]
    assert rows(data.messages, "session_id", "turn", "role", "text")[0] == ("q1-session-0", 0, "user", "hi")
    assert rows(data.question_sessions)[1:] == [("q2", "q2-session-0", 0), ("q2", "q2-session-1", 1)]
    assert [r.question_id for r in data.questions.orderBy("pos").collect()] == ["q1", "q2"]
    assert rows(data.types()) == [("t",)]


def keyed(category=2):
    turn = [{"speaker": "Ann", "text": "hello"}, {"speaker": "Bob", "text": "hey"}]
    return {"sample_id": "s1", "qa": [{"question": "a?", "answer": 3, "evidence": ["D1"], "category": 1}, {"question": "b?", "answer": "x", "category": category}],
            "conversation": {"speaker_a": "Ann", "speaker_b": "Bob", "session_1": turn, "session_1_date_time": "1:56 pm on 8 May, 2023",
                             "session_2": "not a list", "session_3": turn[:1], "session_5": turn}}


def test_keyed_sessions(spark, rows, tmp_path):
    put(tmp_path / "x.json", [keyed()])
    data = ds.load_keyed_sessions(spark, str(tmp_path))
    assert rows(data.sessions, "session_id", "date") == [("s1-session_1", "2023-05-08T13:56:00.000Z"), ("s1-session_3", None)]
    assert rows(data.questions, "question_id", "question_type", "ground_truth") == [("s1-q0", "single-hop", "3"), ("s1-q1", "multi-hop", "x")]
    assert rows(data.messages, "session_id", "role", "speaker") == [
        ("s1-session_1", "assistant", "Bob"), ("s1-session_1", "user", "Ann"), ("s1-session_3", "user", "Ann")]
    assert rows(data.question_sessions) == [(f"s1-q{q}", f"s1-session_{n}", n) for q in (0, 1) for n in (1, 3)]


def test_unknown_category_raises(spark, tmp_path):
    put(tmp_path / "x.json", [keyed(9)])
    with pytest.raises(PySparkException, match="unknown category"):
        ds.load_keyed_sessions(spark, str(tmp_path)).questions.collect()


def test_evidence_items(spark, rows, tmp_path):
    item = {"question": "q", "answer": "a", "message_evidences": [{"speaker": "User", "text": "e"}],
            "conversations": [{"messages": [{"speaker": "USER", "text": "one"}, {"speaker": "Bot", "text": "two"}]}]}
    path = put(tmp_path / "e.json", [{"category": "facts", "item": item}, {"category": "changing", "item": {**item, "conversations": None}}])
    data = ds.load_evidence_items(spark, path)
    assert rows(data.questions, "question_id", "question_type") == [("convomem-changing-1", "changing"), ("convomem-facts-0", "facts")]
    assert rows(data.messages, "session_id", "role") == [("convomem-facts-0-session-0", "assistant"), ("convomem-facts-0-session-0", "user")]


def test_strip_answer_leak(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit("u").alias("role"), F.lit(True).alias("has_answer"))).alias("messages"))
    assert ds.strip_answer_leak(df).schema["messages"].dataType.elementType.names == ["role"]


def test_index_round_trip(spark, rows, tmp_path):
    messages = spark.createDataFrame([("c", f"s{i % 3}", i, "user", f"apple {i} text") for i in range(9)],
                                     "container string, session_id string, turn bigint, role string, text string")
    index = ix.build_index(messages)
    tb.write_index(index, str(tmp_path))
    back = tb.read_index(spark, str(tmp_path))
    for a, b in ((index.chunks, back.chunks), (index.postings, back.postings), (index.stats, back.stats)):
        assert rows(a, *sorted(a.columns)) == rows(b, *sorted(a.columns))
    new = spark.createDataFrame([("c", "c_s0_0", "replaced")], "container string, chunk_id string, content string")
    tb.merge_chunks(spark, f"{tmp_path}/chunks", new, f"{tmp_path}/merged")
    merged = dict(rows(spark.read.parquet(f"{tmp_path}/merged"), "chunk_id", "content"))
    assert len(merged) == 3 and merged["c_s0_0"] == "replaced"


def test_chunks_do_not_depend_on_a_sessions_length(spark):
    import random

    from tidemark.functions.text import sentence_chunks

    rng = random.Random(2)
    words = ["tea", "likes. ", "a", "\n", "longer" * 9, " ", "the end."]
    rows = [("c", "long", i, "user", " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(12_000)]
    rows += [("c", "tiny", 0, "user", "x"), ("c", "null", 0, "user", None), ("d", "long", 0, "user", "y" * 5000),
             ("d", "edge", 0, "u", "z" * 97), ("d", "edge1", 0, "u", "z" * 98)]
    messages = spark.createDataFrame(rows, "container string, session_id string, turn bigint, role string, text string")
    for size, overlap in ((100, 20), (1600, 320)):
        whole = ix.transcripts(messages).select("container", "session_id", F.posexplode(
            sentence_chunks(F.col("content"), size, overlap)).alias("chunk_index", "content"))
        got = ix.chunk_sessions(messages, size, overlap)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_graph_round_trip(spark, rows, tmp_path):
    ent = spark.createDataFrame([("g", "a", "t", "s", 1)], "container string, name string, type string, summary string, n_sessions bigint")
    edges = spark.createDataFrame([("g", "a", "r", "b", None, "s", 1)],
                                  "container string, source string, relation string, target string, date string, session_id string, ord bigint")
    tb.write_graph(ent, edges, str(tmp_path))
    a, b = tb.read_graph(spark, str(tmp_path))
    assert rows(a) == rows(ent) and rows(b) == rows(edges)


def test_runs_skip_broken_documents(spark, rows, tmp_path):
    phase = {"status": "completed", "durationMs": 5, "score": 1, "label": "correct"}
    doc = {"runId": "r1", "status": "running", "provider": "p", "benchmark": "b",
           "questions": {"q1": {"questionId": "q1", "questionType": "t", "phases": {"evaluate": phase, "search": {"status": "pending"}}}}}
    for name, text in (("r1", json.dumps(doc)), ("r2", "{broken"), ("r3", json.dumps({**doc, "runId": "r3", "questions": {}}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "checkpoint.json").write_text(text)
    runs, log = tb.read_runs(spark, f"{tmp_path}/*/checkpoint.json")
    assert rows(runs, "run_id", "provider") == [("r1", "p"), ("r3", "p")]
    assert rows(log, "phase", "status", "duration_ms", "score") == [("evaluate", "completed", 5, 1), ("search", "pending", None, None)]


def test_text_files(spark, rows, tmp_path):
    for name in ("2024-01-02-note.md", "b.txt", "c.json"):
        (tmp_path / name).write_text(f"line\n{name}")
    assert rows(tb.read_text_files(spark, [str(tmp_path)]), "stem", "date", "text") == [
        ("2024-01-02-note", "2024-01-02", "line\n2024-01-02-note.md"), ("b", None, "line\nb.txt")]


def test_append_messages(spark, rows):
    schema = "container string, session_id string, messages array<struct<role:string,content:string>>, text string"
    df = spark.createDataFrame([("ok", "s1", [("user", "hi")], None), ("ok", "s2", None, "note"), ("ok", None, [("user", "x")], None),
                                ("bad name", "s3", None, "t"), ("ok", "s4", [], ""), (None, "s5", None, "t")], schema)
    good, bad = tb.append_messages(df)
    assert [(r.session_id, r.messages[0].content) for r in good.orderBy("session_id").collect()] == [("s1", "hi"), ("s2", "note")]
    assert rows(bad, "session_id", "reason") == [
        ("s3", "invalid container"), ("s4", "container, session and messages required"),
        ("s5", "container, session and messages required"), (None, "container, session and messages required")]


def test_search_records_keep_empty_questions(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, rank int, chunk_id string")
    got = {r.query_id: [x.chunk_id for x in r.results] for r in tb.search_records(q, hits, ["chunk_id"]).collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_run_files_hold_many_runs(spark, tmp_path, monkeypatch):
    """Files are a fraction of the runs, and each run's phases are read from them."""
    from tidemark.catalog import files
    from tidemark.catalog.base import Tables

    (tmp_path / "in").mkdir()
    spark.range(2000).selectExpr("id AS event_id", "id % 200 AS user_id", "'view' AS event_type", "id % 40 * 1.0D AS value").write.parquet(
        f"{tmp_path}/in/events.parquet")
    spark.range(2).write.parquet(f"{tmp_path}/in/region.parquet")
    monkeypatch.setattr(files, "scratch_path", lambda *a: f"{tmp_path}/runs")
    got = files.run_files(Tables(spark, f"{tmp_path}/in")).collect()
    assert len(list((tmp_path / "runs").glob("part-*"))) <= 200 // 64 + 3
    assert sorted((r.run_id, r.question_id, r.status, r.duration_ms) for r in got) == sorted(
        (f"r{i % 200}", f"q{i}", "failed" if i % 40 < 20 else "completed", i) for i in range(2000))
