"""Accuracy and latency reports over evaluated questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import exact_positions

# Question phases in order.
PHASES = ("ingest", "indexing", "search", "answer", "evaluate")

LATENCY_POINTS = {"median": 0.5, "p95": 0.95, "p99": 0.99}


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def latency_stats(df: DataFrame, value: str, by: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """min, max, mean, median, p95, p99, standard deviation and count of the positive values.

    Percentiles are the sorted value at ``floor(n * p)``; the deviation is the population one; mean
    and deviation are rounded to integers. ``groups`` lists groups that must appear even if empty.
    """
    by = list(by)
    positive = df.where(F.col(value) > 0)
    basic = positive.groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"),
        round_half_up(F.avg(value)).alias("mean"),
        round_half_up(F.stddev_pop(value)).alias("std_dev"),
        F.count("*").alias("count"),
    )
    out = basic.join(exact_positions(positive, by, value, LATENCY_POINTS), by)
    if groups is not None:
        out = groups.select(*by).distinct().join(out, by, "left").fillna(0)
    return out.select(*by, "min", "max", "mean", "median", "p95", "p99", "std_dev", "count")


def accuracy_by_type(results: DataFrame, type_col: str = "question_type") -> DataFrame:
    """Totals per type plus one ``(all)`` row, from a single rollup. Correct means score = 1."""
    rolled = results.rollup(type_col).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("score") == 1).alias("correct"),
        F.grouping(type_col).alias("_all"),
    )
    return rolled.where((F.col("_all") == 0) | (F.col("total") > 0)).select(
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col(type_col)).alias(type_col),
        "total", "correct",
        F.round(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), 6).alias("accuracy"),
    )


def question_totals(phase_log: DataFrame) -> DataFrame:
    """Five-phase duration per (run, question); a missing duration counts 0."""
    return phase_log.where(F.col("phase").isin(*PHASES)).groupBy("run_id", "question_id").agg(
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_ms")
    )


def evaluated(questions: DataFrame, phase_log: DataFrame, results: DataFrame) -> DataFrame:
    """One row per (run, question) whose evaluation is complete: its type, score, the duration of each
    phase (null if the log has none) and their ``total``.

    ``questions`` is (question_id, question_type), ``phase_log`` (run_id, question_id, phase, status,
    duration_ms) with one row per phase, ``results`` (run_id, question_id, score).
    """
    key = ["run_id", "question_id"]
    spent = [F.max(F.when(F.col("phase") == p, F.col("duration_ms"))).alias(p) for p in PHASES]
    done = F.bool_or((F.col("phase") == "evaluate") & (F.col("status") == "completed")).alias("_done")
    total = sum((F.coalesce(p, F.lit(0)) for p in PHASES), F.lit(0)).cast("bigint")
    return (
        phase_log.groupBy(*key).agg(done, *spent).where("_done").drop("_done")
        .withColumn("total", total)
        .join(results, key, "left").join(questions, "question_id")
        .withColumn("score", F.coalesce("score", F.lit(0)))
    )


def _durations(rows: DataFrame, by: Sequence[str], phases: Sequence[str]) -> DataFrame:
    """Latency statistics of the phases in every group, zeros for a phase without durations."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("duration_ms")) for p in phases]))
    long = rows.select(*by, pairs.alias("_p")).select(*by, "_p.phase", "_p.duration_ms")
    return latency_stats(long, "duration_ms", [*by, "phase"], long)


def type_latency(rows: DataFrame) -> DataFrame:
    """Search, answer and total latency per run and question type of ``evaluated`` rows."""
    return _durations(rows, ["run_id", "question_type"], ("search", "answer", "total"))


def report(questions: DataFrame, phase_log: DataFrame, results: DataFrame
           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, by_type, latency) per run over questions whose evaluation is complete."""
    rows = evaluated(questions, phase_log, results)
    correct = F.count_if(F.col("score") == 1).alias("correct")
    total = F.count("*").alias("total")
    accuracy = F.round(F.col("correct") / F.col("total"), 6)
    summary = rows.groupBy("run_id").agg(total, correct).withColumn("accuracy", accuracy)
    by_type = rows.groupBy("run_id", "question_type").agg(total, correct).withColumn("accuracy", accuracy)
    return summary, by_type, _durations(rows, ["run_id"], (*PHASES, "total"))
