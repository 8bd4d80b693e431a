"""Incremental index upsert and live progress."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import Index, index_chunks
from ..plans.skew import first_row


def append_chunks(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append chunk batches ``(container, chunk_id, content, version)`` to a log at ``path``.

    A batch only appends, so its cost does not grow with the table. The checkpoint names the writer:
    a batch that it delivers again rewrites its own folder, and no other writer or new checkpoint
    touches it.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{path}/writer={writer}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Latest row per chunk id of the log.

    The version decides, since batches of different writers have no order; of equal versions the
    later batch counts, then the writer's name and the content.
    """
    log = spark.read.parquet(path).drop("batch").withColumn("writer", F.col("writer").cast("string"))
    order = [F.col(c).desc() for c in ("version", "batch_id", "writer", "content")]
    return first_row(log, ["container", "chunk_id"], order).drop("batch_id", "writer")


def current_index(spark: SparkSession, path: str) -> Index:
    """Index over the latest rows; vanished terms leave no postings behind."""
    return index_chunks(current_chunks(spark, path))


def refresh_containers(index: Index, chunks: DataFrame, touched: DataFrame) -> Index:
    """Recompute postings and statistics of the touched containers and keep the others."""
    names = touched.select("container").distinct()
    fresh = index_chunks(chunks.join(names, "container", "left_semi"))
    return Index(
        chunks,
        index.postings.join(names, "container", "left_anti").unionByName(fresh.postings),
        index.stats.join(names, "container", "left_anti").unionByName(fresh.stats),
    )


def live_progress(stream: DataFrame, run: str = "run_id", phase: str = "phase", status: str = "status") -> DataFrame:
    """Running counts per (run, phase, status)."""
    return stream.groupBy(run, phase, status).agg(F.count("*").alias("n"))


def state_changes(stream: DataFrame, run: str = "run_id", question: str = "question_id", phase: str = "phase",
                  status: str = "status", at: str = "at", slots: int = 1) -> DataFrame:
    """(run, phase, status, change): +1 where a question enters a status, -1 where it leaves one.

    The last status of each phase of a question counts, by ``at`` (a number), of equal ones by the greater name. Repeated and
    late rows change nothing, and a batch that sees several updates emits only their outcome, so sums over any batches are
    the counts of the last state (``progress_totals``). Rows without run, question, phase, status or ``at`` count nowhere.

    One state holds all questions of a run: a state of its own for each question costs milliseconds a question. Runs of very
    many questions can be dealt over ``slots`` states each; a checkpoint keeps the number it began with.
    """
    rows = stream.select(run, question, phase, status, F.col(at).cast("bigint").alias(at)).na.drop()
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64(question), F.lit(slots)))
    schema = T.StructType([rows.schema[run], rows.schema[phase], T.StructField("status", T.StringType()),
                           T.StructField("change", T.LongType())])
    kept = T.StructType([T.StructField("questions", T.ArrayType(rows.schema[question].dataType)),
                         T.StructField("phases", T.ArrayType(rows.schema[phase].dataType)),
                         T.StructField("ats", T.ArrayType(T.LongType())),
                         T.StructField("statuses", T.ArrayType(T.StringType()))])

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = {(q, p): (a, s) for q, p, a, s in zip(*state.get, strict=True)} if state.exists else {}
        before: dict[tuple, str | None] = {}
        for batch in batches:
            for q, p, s, a in zip(*(batch[c].tolist() for c in (question, phase, status, at)), strict=True):
                last = now.get((q, p))
                if last is None or (a, s) > last:
                    before.setdefault((q, p), last and last[1])
                    now[q, p] = (a, s)
        if before:
            state.update(([q for q, _ in now], [p for _, p in now], [a for a, _ in now.values()], [s for _, s in now.values()]))
        moved = [(p, old, now[q, p][1]) for (q, p), old in before.items() if old != now[q, p][1]]
        out = [(key[0], p, old, -1) for p, old, _ in moved if old is not None] + [(key[0], p, new, 1) for p, _, new in moved]
        yield pd.DataFrame(out, columns=schema.names)

    return rows.groupBy(run, "_slot").applyInPandasWithState(follow, schema, kept, "append", GroupStateTimeout.NoTimeout)


def progress_totals(changes: DataFrame, run: str = "run_id", phase: str = "phase") -> DataFrame:
    """(run, phase, status, n) of the last states, from all changes so far."""
    return changes.groupBy(run, phase, "status").agg(F.sum("change").alias("n")).where("n <> 0")


def hourly_progress(stream: DataFrame, ts: str, phase: str, watermark: str = "1 hour") -> DataFrame:
    """Counts per hour and phase; rows later than the watermark are dropped and counted by Spark."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    return timed.groupBy(F.window("_ts", "1 hour").alias("_w"), phase).agg(F.count("*").alias("n")).select(
        F.col("_w.start").alias("hour"), phase, "n")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows the query has dropped as too late so far."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress for operator in progress.get("stateOperators", [])
    )
