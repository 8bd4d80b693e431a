"""Parquet, JSON and text tables of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_from_filename, valid_container
from ..operators.index import Index, upsert_chunks
from ..schemas import CHUNKS, ENTITIES, RELATIONSHIPS


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks clustered by container and id, so that container filters skip row groups.

    The range split follows sizes: a container with most of the rows fills many files.
    """
    chunks.repartitionByRange("container", "chunk_id").sortWithinPartitions("container", "chunk_id").write.mode(
        mode).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def merge_chunks(spark: SparkSession, path: str, new: DataFrame, target: str, version: str | None = None) -> None:
    """Write the chunks of ``path`` with ``new`` replaced or added to ``target``."""
    write_chunks(upsert_chunks(spark.read.parquet(path), new, version), target)


def write_index(index: Index, path: str) -> None:
    """The index tables, postings clustered by (container, term) for row-group skipping."""
    write_chunks(index.chunks, f"{path}/chunks")
    index.postings.repartitionByRange("container", "term", "chunk_id").sortWithinPartitions(
        "container", "term").write.mode("overwrite").parquet(f"{path}/postings")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("chunks", "postings", "stats")))


def write_graph(entities: DataFrame, edges: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    edges.write.mode("overwrite").parquet(f"{path}/relationships")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(ENTITIES).parquet(f"{path}/entities"),
            spark.read.schema(RELATIONSHIPS).parquet(f"{path}/relationships"))


def search_records(questions: DataFrame, hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One record per question with its ranked results; questions without results keep an empty list."""
    packed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("results"))
    return questions.join(packed, "query_id", "left").withColumn("results", F.coalesce("results", F.array()))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


_PHASE = "struct<status:string,startedAt:string,completedAt:string,durationMs:bigint,error:string,score:int,label:string>"
_RUN = (
    "runId STRING, dataSourceRunId STRING, status STRING, provider STRING, benchmark STRING, judge STRING, "
    "answeringModel STRING, createdAt STRING, updatedAt STRING, _broken STRING, "
    "questions MAP<STRING, STRUCT<questionId: STRING, questionType: STRING, phases: MAP<STRING, "
    + _PHASE.replace("struct<", "STRUCT<") + ">>>"
)


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, phase_log) from files of one run document or an array of them; files that cannot be read are skipped whole."""
    raw = spark.read.schema(_RUN).option("multiLine", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_broken").json(path)
    good = raw.where(F.col("_broken").isNull() & F.col("runId").isNotNull())
    runs = good.select(
        F.col("runId").alias("run_id"), F.col("dataSourceRunId").alias("data_source_run_id"), "status", "provider",
        "benchmark", "judge", F.col("answeringModel").alias("answering_model"), F.col("createdAt").alias("created_at"))
    questions = good.select(F.col("runId").alias("run_id"), F.explode("questions").alias("question_id", "_q"))
    phases = questions.select("run_id", "question_id", F.col("_q.questionType").alias("question_type"),
                              F.explode("_q.phases").alias("phase", "_p"))
    log = phases.select(
        "run_id", "question_id", "question_type", "phase", "_p.status", F.col("_p.startedAt").alias("started_at"),
        F.col("_p.completedAt").alias("completed_at"), F.col("_p.durationMs").alias("duration_ms"), "_p.error",
        "_p.score", "_p.label")
    return runs, log


def read_text_files(spark: SparkSession, folders: Sequence[str], extensions: Sequence[str] = ("md", "txt")) -> DataFrame:
    """Whole files of the folders with name, stem and the date their name starts with."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.option("pathGlobFilter", glob).text(list(folders), wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(
        name.alias("file_name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"),
        date_from_filename(name).alias("date"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def append_messages(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) message batches.

    ``incoming`` is (container, session_id, messages, text). A text without messages becomes a
    one-message user session. Rows without container, session or messages, and rows with an
    invalid container name, are rejected with a reason.
    """
    single = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    has_text = F.coalesce(F.length("text") > 0, F.lit(False))
    messages = F.when(F.size("messages") > 0, F.col("messages")).when(has_text, single)
    rows = incoming.withColumn("messages", messages)
    missing = (
        (F.coalesce("container", F.lit("")) == "") | (F.coalesce("session_id", F.lit("")) == "")
        | F.col("messages").isNull()
    )
    reason = F.when(missing, "container, session and messages required").when(
        ~valid_container(F.col("container")), "invalid container")
    rows = rows.withColumn("reason", reason)
    accepted = rows.where(F.col("reason").isNull()).select("container", "session_id", "messages")
    return accepted, rows.where(F.col("reason").isNotNull())
