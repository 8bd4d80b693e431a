import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as ix
from tidemark.operators import search as se
from tidemark.sources import kept

SCHEMA = "container string, chunk_id string, content string, version bigint, deleted boolean"
WORDS = "apple plum fig cherry pear the of quince".split()


def brute(batches):
    """Highest version, then the later batch, then a deletion; what is not deleted stays."""
    held = {}
    for batch in batches:
        best = {}
        for box, name, text, version, deleted in batch:
            if box is None or name is None:
                continue
            one = (version if version is not None else -(1 << 63), bool(deleted), text)
            best[box, name] = max(best.get((box, name), one), one, key=lambda x: x[:2])
        for key, one in best.items():
            if key not in held or one[0] >= held[key][0]:
                held[key] = one
    return sorted((*k, v[2]) for k, v in held.items() if not v[1])


def made(seed, batches=9, rows=25):
    rng = random.Random(seed)
    return [[(rng.choice("abcccc"), str(rng.randint(0, 30)), " ".join(rng.choices(WORDS, k=rng.randint(0, 6))),
              10 * i + j % 7 - rng.choice([0, 0, 15]), rng.random() < .15) for j in range(rows)] for i in range(batches)]


def unique(batch):
    """One row a (chunk, version), so that no hash has to decide."""
    return list({r[:2] + r[3:4]: r for r in batch}.values())


def same_index(spark, rows, got):
    want = ix.index_chunks(got.chunks)
    for a, b in ((got.postings, want.postings), (got.stats, want.stats)):
        assert rows(a, *sorted(a.columns)) == rows(b, *sorted(b.columns))
    assert rows(got.forward, "container", "chunk_id", "dl") == rows(want.forward, "container", "chunk_id", "dl")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_rebuild(spark, rows, tmp_path, seed):
    path, batches = str(tmp_path / "ix"), [unique(b) for b in made(seed)]
    kept.create_kept(spark, path)
    merged = 0
    for i, batch in enumerate(batches):
        kept.add_batch(spark, path, spark.createDataFrame(batch, SCHEMA), "w", i)
        merged += kept.merge_parts(spark, path, 3)
    got = kept.read_kept(spark, path)
    assert merged
    assert rows(got.chunks) == brute(batches)
    same_index(spark, rows, got)
    query = spark.createDataFrame([(1, "c", "apple quince"), (2, "a", "fig")], "query_id int, container string, text string")
    cols = ("query_id", "chunk_id", "bm25_raw", "rank")
    assert rows(se.bm25_top_k(query, got, 5), *cols) == rows(se.bm25_top_k(query, ix.index_chunks(got.chunks), 5), *cols)


def test_a_batch_writes_one_part_and_comes_once(spark, rows, tmp_path):
    path = str(tmp_path / "ix")
    kept.create_kept(spark, path)
    first = spark.createDataFrame([("a", str(i), "apple", 1, False) for i in range(50)], SCHEMA)
    kept.add_batch(spark, path, first, "w", 0)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    for _ in range(2):
        kept.add_batch(spark, path, spark.createDataFrame([("a", "3", "plum", 2, False), ("a", "4", None, 2, True)], SCHEMA), "w", 1)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    state = kept.kept_state(spark, path)
    assert [(p.n, p.gone) for p in state.parts] == [(50, 0), (2, 2)]
    assert rows(kept.read_kept(spark, path).stats) == [("a", 49, 49, 1.0)]
    # An older version that comes late brings neither back.
    kept.add_batch(spark, path, first, "other", 0)
    assert state.parts[0].n == 50 and rows(kept.read_kept(spark, path).stats) == [("a", 49, 49, 1.0)]


def test_dead_jobs_leave_the_former_state(spark, rows, tmp_path, monkeypatch):
    path, batches = str(tmp_path / "ix"), [unique(b) for b in made(5, 4)]
    kept.create_kept(spark, path)
    for i, batch in enumerate(batches[:3]):
        kept.add_batch(spark, path, spark.createDataFrame(batch, SCHEMA), "w", i)
    with monkeypatch.context() as m:
        def die(*_):
            raise RuntimeError("lost")
        m.setattr(kept, "_commit", die)
        with pytest.raises(RuntimeError):
            kept.merge_parts(spark, path, 3)
        with pytest.raises(RuntimeError):
            kept.add_batch(spark, path, spark.createDataFrame(batches[3], SCHEMA), "w", 3)
    assert rows(kept.read_kept(spark, path).chunks) == brute(batches[:3])
    assert kept.merge_parts(spark, path, 3)
    kept.add_batch(spark, path, spark.createDataFrame(batches[3], SCHEMA), "w", 3)
    got = kept.read_kept(spark, path)
    assert rows(got.chunks) == brute(batches)
    same_index(spark, rows, got)


def test_empty_odd_and_second_writer(spark, rows, tmp_path):
    path = str(tmp_path / "ix")
    kept.create_kept(spark, path)
    assert rows(kept.read_kept(spark, path).chunks) == rows(kept.read_kept(spark, path).stats) == []
    odd = [(None, "1", "x y", 1, False), ("a", None, "plum", 1, False), ("a", "2", None, None, None), ("a", "2", None, None, None)]
    kept.add_batch(spark, path, spark.createDataFrame(odd, SCHEMA), "w", 0)
    kept.add_batch(spark, path, spark.createDataFrame([], SCHEMA), "w", 1)
    # Columns of the names used inside are the caller's and stay out.
    clash = spark.createDataFrame([("a", "3", "fig", 7, "mine")], "container string, chunk_id string, content string, terms int, part string")
    kept.add_batch(spark, path, clash, "w", 2)
    got = kept.read_kept(spark, path)
    assert rows(got.chunks) == [("a", "2", None), ("a", "3", "fig")]
    assert rows(got.stats) == [("a", 2, 1, 0.5)]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        kept._commit(spark, path, kept.kept_state(spark, path))


def test_stream(spark, rows, tmp_path):
    path, src, batches = str(tmp_path / "ix"), str(tmp_path / "in"), [unique(b) for b in made(8, 4)]
    kept.create_kept(spark, path)
    stream = spark.readStream.schema(SCHEMA).parquet(src + "/*")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).write.parquet(f"{src}/{i}")
        kept.keep_up(stream, path, str(tmp_path / "log"), 2).awaitTermination()
    got = kept.read_kept(spark, path)
    assert rows(got.chunks) == brute(batches)
    assert len(kept.kept_state(spark, path).parts) < 4
    same_index(spark, rows, got)


def test_merged_parts_without_rows_still_take_back(spark, rows, tmp_path):
    path = str(tmp_path / "ix")
    kept.create_kept(spark, path)

    def put(names, word, version):
        kept.add_batch(spark, path, spark.createDataFrame([("a", n, word, version, False) for n in names], SCHEMA))

    everything = [str(i) for i in range(20)]
    put(everything, "apple", 1)
    put(["1", "2"], "plum", 2)
    put(["3", "4"], "plum", 2)
    put(everything[:10], "fig pear", 3)
    assert kept.merge_parts(spark, path, 2)
    assert 0 in [p.n for p in kept.kept_state(spark, path).parts]
    got = kept.read_kept(spark, path)
    assert rows(got.chunks) == sorted(("a", n, "fig pear" if int(n) < 10 else "apple") for n in everything)
    same_index(spark, rows, got)


def test_a_batch_counts_its_texts_once_and_moves_no_terms(spark, tmp_path, monkeypatch):
    """Terms are counted after the rows are laid out, and the statistics come from the rows as written."""
    plain, touched = kept.term_runs, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(kept, "term_runs", lambda tokens: plain(F.split(F.udf(
        lambda t: (touched.add(1), " ".join(t or []))[1], "string").asNondeterministic()(tokens), " ")))
    path = str(tmp_path / "kept")
    kept.create_kept(spark, path, "container STRING, chunk_id BIGINT, content STRING")
    batch = spark.createDataFrame([("c", i, f"alpha w{i} beta") for i in range(50)], "container string, chunk_id bigint, content string")
    kept.add_batch(spark, path, batch, "w", 0)
    assert touched.value == 50
    assert kept.read_kept(spark, path).stats.first().total_len == 150


def test_many_replaced_keys_are_sent_in_turns(spark, tmp_path, monkeypatch, rows):
    path = str(tmp_path / "kept")
    kept.create_kept(spark, path, "container STRING, chunk_id BIGINT, content STRING")
    schema = "container string, chunk_id bigint, content string, version int"
    kept.add_batch(spark, path, spark.createDataFrame([("c", i, f"old w{i}", 1) for i in range(60)], schema))
    kept.add_batch(spark, path, spark.createDataFrame([("c", i, f"new w{i}", 2) for i in range(40)], schema))
    want = sorted([("c", i, f"new w{i}") for i in range(40)] + [("c", i, f"old w{i}") for i in range(40, 60)], key=repr)
    for most, turns in ((500_000, 1), (10, 4), (4, 10)):
        monkeypatch.setattr(kept, "BROADCAST_ROWS", most)
        chunks = kept.read_kept(spark, path).chunks
        plan = chunks._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftAnti") == (turns if turns <= kept.SENT_TURNS else 1)
        assert rows(chunks) == want
