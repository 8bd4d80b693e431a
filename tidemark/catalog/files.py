"""Queries over files that are written from the test tables and read back, and over kept-up indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators.retriever import RETRIEVERS
from ..plans.scratch import scratch_path
from ..sources import datasets as ds
from ..sources import kept
from ..sources.tables import read_runs, read_text_files
from ..streaming import feeds
from .base import Tables, query
from .shapes import bm25_ctes, corpus, items

# Array files hold the elements of one such group; a group is a value, as in the files that are read.
GROUPS = 64
# A file of run documents holds those of 2 ** RUN_BITS neighbouring user ids.
RUN_BITS = 6


def _array_files(rows: DataFrame, key: str, element: Column, path: str, to_json: bool = True) -> None:
    """Files that hold one JSON array each, elements (values, or texts as they are) in the order of ``key``."""
    element = F.to_json(element) if to_json else element
    put = rows.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("g"), F.struct(key, element.alias("e")).alias("s"))
    text = put.groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("l")).select(
        F.concat(F.lit("["), F.array_join(F.transform("l", lambda s: s["e"]), ","), F.lit("]")).alias("value"))
    # One array a file.
    text.write.option("maxRecordsPerFile", 1).text(path)


def _talks(t: Tables) -> DataFrame:
    """Conversations with sessions of two turns."""
    told = t("conversations").withColumn("n", F.col("turn").cast("int").bitwiseAND(~1) / 2)
    each = told.groupBy("conv_id", F.col("n").cast("int").alias("n")).agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "text"))).alias("m"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "m"))).alias("sessions"))


_SESSIONS = "w AS (SELECT conv_id, turn // 2 AS n, turn % 2 AS turn, role, text FROM conversations)"


@query("positional_sessions", f"""WITH {_SESSIONS}
SELECT 'q' || conv_id || '-session-' || n AS session_id, 'q' || conv_id AS question_id, n AS ord, turn, role, text,
  CASE WHEN n % 3 = 0 THEN '2023-05-08T01:00:00.000Z' END AS date, 'type ' || conv_id % 4 AS question_type FROM w""")
def positional_sessions(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "positional")
    name = F.concat(F.lit("q"), F.col("conv_id").cast("string"))
    one = F.struct(
        name.alias("question_id"), F.lit("what?").alias("question"), F.lit("that").alias("answer"),
        F.concat(F.lit("type "), (F.col("conv_id") % 4).cast("string")).alias("question_type"),
        F.transform("sessions", lambda s: F.when(s["n"] % 3 == 0, "2023/05/08 (Mon) 01:00").otherwise("no date")).alias("haystack_dates"),
        F.transform("sessions", lambda s: F.transform(s["m"], lambda m: F.struct(
            m["role"].alias("role"), m["text"].alias("content"), F.lit(True).alias("has_answer")))).alias("haystack_sessions"))
    _array_files(_talks(t), "conv_id", one, path)
    data = ds.load_positional_sessions(t.spark, path)
    return (
        data.messages.join(data.sessions, "session_id").join(data.question_sessions, "session_id")
        .join(data.questions.select("question_id", "question_type"), "question_id")
        .select("session_id", "question_id", F.col("ord").cast("bigint").alias("ord"), F.col("turn").cast("bigint").alias("turn"),
                "role", "text", "date", "question_type"))


@query("keyed_sessions", f"""WITH {_SESSIONS}
SELECT 's' || conv_id || '-session_' || n + 1 AS session_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role,
  text, role AS speaker, '2023-05-08T13:56:00.000Z' AS date, 's' || conv_id || '-q0' AS question_id,
  CASE conv_id % 5 WHEN 0 THEN 'single-hop' WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'world-knowledge' ELSE 'adversarial' END AS question_type
FROM w WHERE n < 1 OR conv_id % 2 = 0""")
def keyed_sessions(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "keyed")
    # The second session of odd conversations is left out, so reading them stops after the first.
    listed = F.filter("sessions", lambda s: (F.col("conv_id") % 2 == 0) | (s["n"] != 1))

    def key(s: Column) -> Column:
        return F.concat(F.lit("session_"), (s["n"] + 1).cast("string"))

    talk = F.map_concat(
        F.create_map(F.lit("speaker_a"), F.lit("user"), F.lit("speaker_b"), F.lit("assistant")),
        F.map_from_entries(F.transform(listed, lambda s: F.struct(key(s), F.to_json(F.transform(
            s["m"], lambda m: F.struct(m["role"].alias("speaker"), m["text"].alias("text"))))))),
        F.map_from_entries(F.transform(listed, lambda s: F.struct(
            F.concat(key(s), F.lit("_date_time")), F.lit("1:56 pm on 8 May, 2023")))))
    asked = F.array(F.struct(F.lit("what?").alias("question"), F.lit("that").alias("answer"),
                             (F.col("conv_id") % 5 + 1).cast("int").alias("category")))
    one = F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sample_id"), asked.alias("qa"),
                   talk.alias("conversation"))
    _array_files(_talks(t), "conv_id", one, path)
    data = ds.load_keyed_sessions(t.spark, path)
    return (
        data.messages.join(data.sessions.select("session_id", "date"), "session_id").join(data.question_sessions, "session_id")
        .join(data.questions.select("question_id", "question_type"), "question_id")
        .select("session_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "speaker", "date", "question_id", "question_type"))


@query("evidence_items", f"""WITH {_SESSIONS}
SELECT 'kind ' || conv_id % 3 AS question_type, 'what ' || conv_id AS question, n AS ord, turn,
  CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM w""")
def evidence_items(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "evidence")

    def said(m: Column) -> Column:
        return F.struct(F.initcap(m["role"]).alias("speaker"), m["text"].alias("text"))

    one = F.struct(
        F.concat(F.lit("kind "), (F.col("conv_id") % 3).cast("string")).alias("category"),
        F.struct(F.concat(F.lit("what "), F.col("conv_id").cast("string")).alias("question"), F.lit("that").alias("answer"),
                 F.transform("sessions", lambda s: F.struct(F.transform(s["m"], said).alias("messages"))).alias("conversations")).alias("item"))
    _array_files(_talks(t), "conv_id", one, path)
    data = ds.load_evidence_items(t.spark, path)
    return (
        data.messages.join(data.question_sessions, "session_id").join(
            data.questions.select("question_id", "question_type", "question"), "question_id")
        .select("question_type", "question", F.col("ord").cast("bigint").alias("ord"), F.col("turn").cast("bigint").alias("turn"), "role", "text"))


@query("dataset_types", "SELECT DISTINCT 'type ' || conv_id % 4 AS question_type FROM conversations")
def dataset_types(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "types")
    one = F.struct(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question_id"),
                   F.concat(F.lit("type "), (F.col("conv_id") % 4).cast("string")).alias("question_type"))
    _array_files(t("conversations").select("conv_id").distinct(), "conv_id", one, path)
    return ds.load_positional_sessions(t.spark, path).types()


@query("unreadable_elements", """SELECT 'q' || conv_id AS question_id, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE count(*) END AS n_turns,
  CASE WHEN conv_id % 3 = 0 THEN '{"question_id":"q' || conv_id || '","question":oops}' END AS unreadable FROM conversations GROUP BY conv_id""")
def unreadable_elements(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "unreadable")
    name = F.concat(F.lit("q"), F.col("conv_id").cast("string"))
    good = F.to_json(F.struct(name.alias("question_id"), F.transform("sessions", lambda s: F.transform(
        s["m"], lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))).alias("haystack_sessions")))
    bad = F.concat(F.lit('{"question_id":"'), name, F.lit('","question":oops}'))
    _array_files(_talks(t), "conv_id", F.when(F.col("conv_id") % 3 == 0, bad).otherwise(good), path, False)
    data = ds.load_positional_sessions(t.spark, path)
    turns = data.messages.join(data.question_sessions, "session_id").groupBy("question_id").agg(F.count("*").alias("n_turns"))
    told = F.regexp_extract("value", r'"question_id":"(q\d+)"', 1).alias("question_id")
    return turns.withColumn("unreadable", F.lit(None).cast("string")).unionByName(
        data.unreadable.select(told, F.lit(0).cast("bigint").alias("n_turns"), F.col("value").alias("unreadable")))


@query("run_files", """SELECT 'r' || user_id AS run_id, 'q' || event_id AS question_id, event_type AS phase,
CASE WHEN value < 20 THEN 'failed' ELSE 'completed' END AS status, event_id AS duration_ms FROM events""")
def run_files(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "runs")
    phase = F.map_from_arrays(F.array("event_type"), F.array(F.struct(
        F.when(F.col("value") < 20, "failed").otherwise("completed").alias("status"), F.col("event_id").alias("durationMs"))))
    asked = t("events").select("user_id", F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("q"), phase.alias("phases"))
    whole = asked.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("q", F.struct(
        F.col("q").alias("questionId"), "phases")))).alias("questions"))
    text = whole.select(F.shiftright("user_id", RUN_BITS).alias("g"), F.to_json(F.struct(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("runId"), F.lit("completed").alias("status"),
        "questions")).alias("value"))
    # A file holds the documents of a range of user ids, so files are neither tiny nor grow with the table; one cannot be read.
    files = text.groupBy("g").agg(F.sort_array(F.collect_list("value")).alias("l")).select(
        F.concat(F.lit("["), F.array_join("l", ","), F.lit("]")).alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)
    t("region").limit(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return read_runs(t.spark, path)[1].select("run_id", "question_id", "phase", "status", "duration_ms")


@query("text_files", """SELECT string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id""")
def text_files(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "notes")
    line = F.concat("role", F.lit(": "), "text").alias("line")
    whole = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line))).alias("l"))
    whole.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    return read_text_files(t.spark, [path]).select("text")


@query("late_rows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def late_rows(t: Tables) -> DataFrame:
    """Hourly counts of a stream whose second delivery comes after the watermark and is dropped whole."""
    path = scratch_path(t.spark, "late")
    rows = t("events").select("event_id", "event_type", "ts")
    end = rows.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit("end").alias("event_type"), (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"))
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{path}/in/*")

    def deliver(part: DataFrame, name: str) -> None:
        part.write.parquet(f"{path}/in/{name}")
        feeds.hourly_progress(stream, "ts", "event_type", "1 hour").writeStream.format("parquet").option("path", f"{path}/out").option(
            "checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()

    # The end mark moves the watermark past every hour; the rows that come again are late by days.
    for name, part in (("a", rows), ("b", end), ("c", rows)):
        deliver(part, name)
    return t.spark.read.parquet(f"{path}/out").where("event_type <> 'end'").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("retriever_bm25", f"""WITH {bm25_ctes()},
k AS (SELECT query_id, chunk_id, round(bm25_raw, 6) AS b, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_raw, 6) DESC, chunk_id) AS rank
  FROM raw QUALIFY rank <= 5)
SELECT query_id, chunk_id, rank, round(b / max(b) OVER (PARTITION BY query_id), 6) AS score FROM k""")
def retriever_bm25(t: Tables) -> DataFrame:
    engine = RETRIEVERS["bm25"]()
    engine.index(corpus(t))
    return engine.search(items(t), 5).select("query_id", "chunk_id", "rank", "score")


# --- an index kept up by batches ---------------------------------------------------------------

_KEPT = """d AS (SELECT source AS container, doc_id AS chunk_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'new ' END || text AS text
  FROM documents LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) <> 1)"""


def _kept(t: Tables) -> ix.Index:
    """All documents, then new texts of the labelled ones, the toxic ones taken out, and an old delivery once more."""
    path = scratch_path(t.spark, "kept")
    kept.create_kept(t.spark, path, "container STRING, chunk_id BIGINT, content STRING")
    first = t("documents").select(F.col("source").alias("container"), F.col("doc_id").alias("chunk_id"),
                                  F.col("text").alias("content"), F.lit(1).alias("version"))
    marked = first.join(t("labels").select(F.col("doc_id").alias("chunk_id"), "toxic"), "chunk_id")
    new = marked.withColumn("content", F.concat(F.lit("new "), "content")).withColumn("version", F.lit(2))
    out = marked.where("toxic = 1").withColumn("version", F.lit(3)).withColumn("deleted", F.lit(True))
    old = marked.withColumn("content", F.lit("late"))
    for number, batch in enumerate((first, new, out, old.withColumn("version", F.lit(0)))):
        kept.add_batch(t.spark, path, batch, "catalog", number)
        kept.add_batch(t.spark, path, batch, "catalog", number)
        kept.merge_parts(t.spark, path, 2)
    return kept.read_kept(t.spark, path)


@query("kept_chunks", f"WITH {_KEPT} SELECT container, chunk_id, text AS content FROM d")
def kept_chunks(t: Tables) -> DataFrame:
    return _kept(t).chunks


@query("kept_stats", f"""WITH {bm25_ctes(_KEPT)} SELECT container, count(*) AS n_docs,
CAST(sum(dl) AS BIGINT) AS total_len, round(sum(dl) / count(*), 6) AS avgdl FROM dl GROUP BY container""")
def kept_stats(t: Tables) -> DataFrame:
    return _kept(t).stats.withColumn("avgdl", F.round("avgdl", 6))


@query("kept_terms", f"WITH {bm25_ctes(_KEPT)} SELECT container, term, count(*) AS df FROM tf GROUP BY ALL")
def kept_terms(t: Tables) -> DataFrame:
    return _kept(t).term_df()
