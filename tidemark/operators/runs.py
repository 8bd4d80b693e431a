"""Run bookkeeping over ``runs`` and ``phase_log`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import PHASES, round_half_up

# The phase each phase waits for.
PREREQUISITE = {"indexing": "ingest", "search": "indexing", "answer": "search", "evaluate": "answer"}


def _status(phase: str, status: str) -> Column:
    return (F.col("phase") == phase) & (F.col("status") == status)


def phase_funnel(phase_log: DataFrame) -> DataFrame:
    """Per run: questions in total and how many completed each phase."""
    done = {"ingest": "ingested", "indexing": "indexed", "search": "searched", "answer": "answered",
            "evaluate": "evaluated"}
    return phase_log.groupBy("run_id").agg(
        F.count_if(F.col("phase") == "ingest").alias("total"),
        *[F.count_if(_status(p, "completed")).alias(name) for p, name in done.items()],
    )


def indexing_episodes(episodes: DataFrame) -> DataFrame:
    """Per run totals of ``(run_id, document_ids, task_ids, completed_ids, failed_ids)`` id lists; a
    task that an episode names twice counts once.

    Runs without any episode are left out; the percentage is rounded half up.
    """
    def length(name: str, unique: bool = False) -> Column:
        ids = F.array_distinct(name) if unique else F.col(name)
        return F.coalesce(F.greatest(F.size(ids), F.lit(0)), F.lit(0))

    return (
        episodes.groupBy("run_id").agg(
            F.sum(length("document_ids") + length("task_ids", unique=True)).alias("total"),
            F.sum(length("completed_ids")).alias("completed"),
            F.sum(length("failed_ids")).alias("failed"),
        )
        .where(F.col("total") > 0)
        .withColumn("percent", round_half_up(F.try_divide("completed", "total") * 100))
    )


def run_status(runs: DataFrame, phase_log: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Derived status per run; ``runs`` is (run_id, status), ``active`` (run_id, active_status).

    Active state, then a stored end state, then any failed phase, then all evaluated, then partial
    if anything was ingested or the run was running, else pending.
    """
    facts = phase_log.groupBy("run_id").agg(
        F.bool_or((F.col("status") == "failed") & F.col("phase").isin(*PHASES)).alias("any_failed"),
        F.count_if(F.col("phase") == "ingest").alias("total"),
        F.count_if(_status("ingest", "completed")).alias("ingested"),
        F.count_if(_status("evaluate", "completed")).alias("evaluated"),
    )
    rows = runs.join(facts, "run_id", "left").fillna(0, ["total", "ingested", "evaluated"])
    if active is not None:
        rows = rows.join(active, "run_id", "left")
    else:
        rows = rows.withColumn("active_status", F.lit(None).cast("string"))
    derived = (
        F.when(F.col("active_status").isNotNull(), F.col("active_status"))
        .when(F.col("status").isin("completed", "failed"), F.col("status"))
        .when(F.coalesce("any_failed", F.lit(False)), "failed")
        .when((F.col("evaluated") == F.col("total")) & (F.col("total") > 0), "completed")
        .when((F.col("ingested") > 0) | (F.col("status") == "running"), "partial")
        .otherwise("pending")
    )
    return rows.select("run_id", derived.alias("run_status"))


def compare_status(members: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Status per comparison from ``(compare_id, run_status)`` and its own ``(compare_id, state)``."""
    rows = members.groupBy("compare_id").agg(
        F.bool_and(F.col("run_status") == "completed").alias("_all"),
        F.bool_or(F.col("run_status") == "failed").alias("_failed"),
        F.bool_or(F.col("run_status") == "running").alias("_running"),
    )
    rows = rows.join(state, "compare_id", "left") if state is not None else rows.withColumn(
        "state", F.lit(None).cast("string"))
    own = F.coalesce("state", F.lit(""))
    return rows.select(
        "compare_id",
        F.when(own == "stopping", "stopping").when((own == "running") | F.col("_running"), "running")
        .when(F.col("_failed"), "failed").when(F.col("_all"), "completed").otherwise("partial")
        .alias("compare_status"),
    )


def pending_work(targets: DataFrame, phase_log: DataFrame, phase: str,
                 ready: DataFrame | None = None) -> DataFrame:
    """Targets (run_id, question_id) that have not completed ``phase`` but may start it.

    ``ready`` optionally lists rows whose input exists (results for answering, a non-empty
    hypothesis for evaluating).
    """
    key = ["run_id", "question_id"]
    rows = targets.join(phase_log.where(_status(phase, "completed")).select(*key), key, "left_anti")
    if phase in PREREQUISITE:
        before = phase_log.where(_status(PREREQUISITE[phase], "completed")).select(*key)
        rows = rows.join(before, key, "left_semi")
    return rows.join(ready.select(*key), key, "left_semi") if ready is not None else rows


def fork_run(runs: DataFrame, phase_log: DataFrame, source: str, new: str, from_phase: str,
             **overrides: str) -> tuple[DataFrame, DataFrame]:
    """Copy a run under a new id with every phase from ``from_phase`` on reset to pending.

    The copy keeps the original data source run and may override ``judge`` or ``answering_model``.
    """
    order = [*PHASES, "report"]
    reset = F.col("phase").isin(*order[order.index(from_phase):])
    log = phase_log.where(F.col("run_id") == source).withColumn("run_id", F.lit(new))
    cleared = {c: F.when(~reset, F.col(c)) for c in log.columns
               if c not in ("run_id", "question_id", "phase", "status")}
    log = log.withColumns({"status": F.when(reset, "pending").otherwise(F.col("status")), **cleared})
    row = runs.where(F.col("run_id") == source).withColumns({
        "data_source_run_id": F.coalesce("data_source_run_id", F.lit(source)),
        "run_id": F.lit(new),
        "status": F.lit("running"),
        **{name: F.lit(value) for name, value in overrides.items() if value},
    })
    return row, log


def run_accuracy(results: DataFrame) -> DataFrame:
    """Accuracy over evaluated questions (null without any), and over all questions."""
    return results.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("evaluated")).alias("evaluated"),
        F.count_if(F.col("evaluated") & (F.col("score") == 1)).alias("correct"),
    ).withColumns({
        "accuracy": F.round(F.try_divide("correct", "evaluated"), 6),
        "accuracy_all": F.round(F.col("correct") / F.col("total"), 6),
    })
