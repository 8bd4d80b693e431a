"""JSON arrays cut at file splits, against a plain JSON reader."""

import json

import pytest

from tidemark.sources import datasets as ds
from tidemark.sources.elements import json_elements, parsed

NASTY = ["", "}", "{\"a\": [", "\\", "\\\"", "},{", "é}ü", "a\\u007d}", "line\nbreak", "]", ",", "\"}"]


def made(n):
    return [{"id": i, "text": NASTY[i % len(NASTY)] * (i % 5), "more": [{"x": NASTY[(i * 7) % len(NASTY)]}, []], "z": {}}
            for i in range(n)]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def elements(spark, path):
    return sorted((r.file.rsplit("/", 1)[1], r.ord, json.loads(r.value)) for r in json_elements(spark, str(path)).collect())


@pytest.mark.parametrize("style", [{"indent": None}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}])
def test_one_file_in_many_splits(spark, tmp_path, small_splits, style):
    items = made(300)
    (tmp_path / "a.json").write_text(json.dumps(items, **style), encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = elements(spark, tmp_path)
    assert [(o, v) for _, o, v in got] == list(enumerate(items))


def test_elements_longer_than_splits_and_places_of_other_values(spark, tmp_path, small_splits):
    long = {"text": "{}\"," * 2000, "deep": [[[{"a": {"b": [1, {"c": "}"}]}}]]] * 50}
    items = [None, long, 3, {"a": 1}, [{"no": 1}] * 200, "x, {}", {"b": 2}, long, {}]
    (tmp_path / "a.json").write_text("﻿ \n" + json.dumps(items) + "\n", encoding="utf-8")
    assert [(o, v) for _, o, v in elements(spark, tmp_path)] == [(i, v) for i, v in enumerate(items) if isinstance(v, dict)]


def test_several_files_empty_ones_and_one_object(spark, tmp_path, small_splits):
    items = made(40)
    (tmp_path / "a.json").write_text(json.dumps(items))
    (tmp_path / "b.json").write_text(json.dumps(items[3], indent=1) + "\n\n")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    assert elements(spark, tmp_path) == [("a.json", i, v) for i, v in enumerate(items)] + [("b.json", 0, items[3])]


def test_files_cut_short_and_unreadable_elements_are_reported(spark, tmp_path):
    whole = json.dumps([{"id": 1}, {"id": 2, "text": "x"}])
    for name, text in (("a", whole[:-8]), ("b", whole[:-2]), ("c", whole), ("d", '[{"id": 1}, {"id": oops}, {"id": 3}]')):
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = parsed(json_elements(spark, str(tmp_path)), "id INT, text STRING")
    assert sorted((r.file[-6], r.ord, r.id) for r in good.collect()) == [("c", 0, 1), ("c", 1, 2), ("d", 0, 1), ("d", 2, 3)]
    assert sorted((r.file[-6], r.ord) for r in bad.collect() if r.ord is None) == [("a", None), ("b", None)]
    assert [(r.file[-6], r.ord, r.value) for r in bad.collect() if r.ord is not None] == [("d", 1, '{"id": oops}')]


def test_loader_reads_one_file_in_splits(spark, tmp_path, rows, small_splits):
    items = [{"question_id": f"q{i}", "question": "a {b}?", "answer": "c", "question_type": f"t{i % 3}", "question_date": "",
              "haystack_dates": ["2023/05/08 (Mon) 01:00"],
              "haystack_sessions": [[{"role": "user", "content": NASTY[i % len(NASTY)], "has_answer": True}]]} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(items + [{"question_id": [1, "}"], "question": {}}]).replace('[1, "}"]', "oops"))
    data = ds.load_positional_sessions(spark, str(tmp_path))
    assert rows(data.messages, "session_id", "text") == sorted(
        ((f"q{i}-session-0", NASTY[i % len(NASTY)]) for i in range(60)), key=repr)
    assert [r.ord for r in data.unreadable.collect()] == [60]
