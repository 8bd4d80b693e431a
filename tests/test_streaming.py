import datetime as dtm
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as ix
from tidemark.streaming import capture as cap
from tidemark.streaming import feeds

START = dtm.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, user_id bigint, ts timestamp"


def brute(events, max_rows, idle):
    out = []
    for user in sorted({u for _, u, _ in events}):
        buf = []
        for _, _, t in sorted((e for e in events if e[1] == user), key=lambda e: (e[2], e[0])):
            if buf and (t - buf[-1]).total_seconds() >= idle:
                out.append((user, buf[0], len(buf), "idle"))
                buf = []
            buf.append(t)
            if len(buf) == max_rows:
                out.append((user, buf[0], len(buf), "count"))
                buf = []
        if buf:
            out.append((user, buf[0], len(buf), "open"))
    return out


def made(n=600, seed=9):
    rng = random.Random(seed)
    # One user has a third of all rows.
    return [(i, 1 if i % 3 == 0 else rng.randint(2, 6), START + dtm.timedelta(seconds=rng.choice([1, 30, 299, 300, 301]) * i)) for i in range(n)]


def bursts(seed=4):
    rng, out, at = random.Random(seed), [], START
    for i in range(700):
        at += dtm.timedelta(seconds=rng.choice([2, 2, 2, 2, 3, 400, 40000 if rng.random() < .1 else 5]))
        out.append((i, 1 if i % 3 else rng.randint(2, 4), at))
    return out


def flushes(df):
    return sorted((r.key, r.first_ts, r.n, r.reason) for r in df.collect())


def test_batch_equals_a_buffer(spark):
    for events in (made(), bursts()):
        df = spark.createDataFrame(events, SCHEMA)
        want = sorted(brute(events, 15, 300))
        assert flushes(cap.capture_batch(df, "user_id", "ts", "event_id")) == want
        assert flushes(cap.capture_batch(df, "user_id", "ts", "event_id", bucket="hour")) == want
        assert flushes(cap.capture_batch(df, "user_id", "ts", "event_id", bucket="minute")) == want


def test_stream_equals_batch(spark, tmp_path):
    events = bursts()
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(events, SCHEMA)
    # Two files in time order.
    df.where("event_id < 350").coalesce(1).write.parquet(f"{src}/a")
    df.where("event_id >= 350").coalesce(1).write.parquet(f"{src}/b")
    import glob
    import os
    for i, f in enumerate(sorted(glob.glob(f"{src}/*/*.parquet"))):
        os.utime(f, (1000 + i, 1000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    query = cap.capture(stream, "user_id", "ts", watermark="1 minute").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert feeds.dropped_rows(query) == 0
    got = flushes(spark.read.parquet(out))
    want = brute(events, 15, 300)
    closed = [w for w in want if w[3] != "open"]
    # The stream closes an open rest only once the watermark has passed its idle time.
    rest = {(w[0], w[1], w[2], "idle") for w in want if w[3] == "open"}
    assert sorted(set(got) - rest) == sorted(closed)
    assert len(got) == len(set(got))


def test_late_rows_are_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    late = [(1, 1, START + dtm.timedelta(hours=5)), (2, 1, START + dtm.timedelta(hours=6))], [(3, 1, START + dtm.timedelta(hours=7))], [(4, 1, START)]
    import glob
    import os
    for i, part in enumerate(late):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{src}/{i}")
        for f in glob.glob(f"{src}/{i}/*.parquet"):
            os.utime(f, (1000 + i, 1000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    counts = feeds.hourly_progress(stream.withColumn("phase", F.lit("p")), "ts", "phase", "10 minutes")
    query = counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert feeds.dropped_rows(query) == 1


def test_incremental_index(spark, rows, tmp_path):
    schema = "container string, chunk_id string, content string, version int"
    src, data = str(tmp_path / "in"), str(tmp_path / "data")
    stream = spark.readStream.schema(schema).parquet(src + "/*")
    spark.createDataFrame([("a", "1", "apple", 1), ("b", "2", "plum", 1)], schema).write.parquet(f"{src}/0")
    feeds.append_chunks(stream, data, str(tmp_path / "log")).awaitTermination()
    spark.createDataFrame([("a", "1", "cherry", 2), ("a", "3", "fig", 1)], schema).write.parquet(f"{src}/1")
    feeds.append_chunks(stream, data, str(tmp_path / "log")).awaitTermination()
    assert rows(feeds.current_chunks(spark, data), "chunk_id", "content") == [("1", "cherry"), ("2", "plum"), ("3", "fig")]
    index = feeds.current_index(spark, data)
    assert rows(index.postings, "term", "chunk_id") == [("cherry", "1"), ("fig", "3"), ("plum", "2")]
    touched = spark.createDataFrame([("a",)], "container string")
    old = ix.index_chunks(spark.createDataFrame([("a", "1", "apple"), ("b", "2", "plum")], "container string, chunk_id string, content string"))
    fresh = feeds.refresh_containers(old, feeds.current_chunks(spark, data), touched)
    assert rows(fresh.postings, "term", "chunk_id") == rows(index.postings, "term", "chunk_id")
    assert rows(fresh.stats, "container", "n_docs", "total_len") == [("a", 2, 2), ("b", 1, 1)]


class _State:
    """Value state and timers of one key, held in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def test_late_rows_do_not_turn_the_clock_back():
    import pandas as pd

    state = _State()
    buffer = cap._Buffer(15, 300_000)
    buffer.init(state)

    def feed(*seconds):
        rows = pd.DataFrame({"us": [s * 1_000_000 for s in seconds], "body": [f"m{s}" for s in seconds]})
        return [tuple(r) for out in buffer.handleInputRows(("anna",), iter([rows]), None)
                for r in out[["key", "first_us", "last_us", "n", "reason", "messages"]].itertuples(index=False)]

    assert feed(1000) == [] and feed(1100) == []
    assert feed(1050) == [] and state.timers == [1_400_000]
    assert feed(1390) == []
    # A row an idle time before the open run is flushed by itself; the run goes on.
    assert feed(650) == [("anna", 650_000_000, 650_000_000, 1, "idle", ["m650"])]
    assert feed(1700) == [("anna", 1_000_000_000, 1_390_000_000, 4, "idle", ["m1000", "m1050", "m1100", "m1390"])]


def test_string_keys_and_messages(spark, tmp_path):
    rows = [(f"user {i % 2}", START + dtm.timedelta(seconds=i), f"text {i}") for i in range(60)]
    spark.createDataFrame(rows, "user string, ts timestamp, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp, text string").parquet(str(tmp_path / "in"))
    cap.capture(stream, "user", "ts", message="text").writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(
        availableNow=True).start().awaitTermination()
    got = sorted((r.key, r.n, r.messages[0]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [("user 0", 15, "text 0"), ("user 0", 15, "text 30")] and got[-1] == ("user 1", 15, "text 31")


def test_two_writers_share_a_log(spark, tmp_path):
    schema = "container string, chunk_id bigint, content string, version bigint"
    sources = {"a": [("c", 1, "old", 1), ("c", 2, "two", 1)], "b": [("c", 1, "new", 2), ("c", 3, "three", 1)]}
    for name, rows in sources.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        feeds.append_chunks(stream, str(tmp_path / "data"), str(tmp_path / f"log-{name}")).awaitTermination()
    got = {r.chunk_id: r.content for r in feeds.current_chunks(spark, str(tmp_path / "data")).collect()}
    assert got == {1: "new", 2: "two", 3: "three"}


def test_progress_follows_the_last_state(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"r{rng.randrange(2)}", f"q{rng.randrange(6)}", rng.choice("ab"), rng.choice(["running", "completed", "failed"]), at)
            for at in range(120)]
    # Late and repeated updates, updates of one time, and rows with gaps.
    sent = rows + rng.sample(rows, 40) + [("r0", "q0", "a", "completed", 7), (None, "q", "a", "x", 1), ("r1", "q1", "a", None, 500)]
    rng.shuffle(sent)
    schema = "run_id string, question_id string, phase string, status string, at bigint"
    for k in range(4):
        spark.createDataFrame(sent[k::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    feeds.state_changes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(f"{tmp_path}/out")
    last = {}
    for run, question, phase, status, at in sent:
        if run and status:
            last[run, question, phase] = max(last.get((run, question, phase), (at, status)), (at, status))
    want = {}
    for (run, _, phase), (_, status) in last.items():
        want[run, phase, status] = want.get((run, phase, status), 0) + 1
    assert {(r.run_id, r.phase, r.status): r.n for r in feeds.progress_totals(changes).collect()} == want
    assert changes.where("change = -1").count() > 0


def test_a_streamed_table_may_be_a_file_or_a_folder(spark, tmp_path):
    import glob
    import shutil

    from tidemark.catalog.base import Tables
    from tidemark.catalog.graphs import _stream

    made_at = str(tmp_path / "made")
    spark.range(30).repartition(3).write.parquet(made_at)
    files = sorted(glob.glob(f"{made_at}/part-*.parquet"))
    (tmp_path / "many" / "rows.parquet").mkdir(parents=True)
    for i, f in enumerate(files):
        shutil.copy(f, tmp_path / "many" / "rows.parquet" / f"part-{i}.parquet")
    (tmp_path / "one").mkdir()
    shutil.copy(files[0], tmp_path / "one" / "rows.parquet")
    shutil.copy(files[1], tmp_path / "one" / "other.parquet")
    for folder, want in (("many", 30), ("one", spark.read.parquet(files[0]).count())):
        out = str(tmp_path / f"out-{folder}")
        _stream(Tables(spark, str(tmp_path / folder)), "rows").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == want


@pytest.mark.parametrize("slots", [1, 3])
def test_progress_states_grow_with_runs_not_questions(spark, tmp_path, slots):
    schema = "run_id string, question_id bigint, phase string, status string, at bigint"
    for k, status in enumerate(["running", "failed", "failed"]):
        spark.createDataFrame([(f"r{q % 2}", q, "a", status if q % 5 else "running", k) for q in range(40)], schema).coalesce(1).write.parquet(
            f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    job = feeds.state_changes(stream, slots=slots).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    job.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    assert held and max(held) <= 2 * slots
    changes = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.run_id, r.status): r.n for r in feeds.progress_totals(changes).collect()} == {
        (r, s): n for r in ("r0", "r1") for s, n in (("failed", 16), ("running", 4))}
