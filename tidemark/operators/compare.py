"""Comparing runs, and the leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import bucketed_row_number
from ..plans.skew import first_row

BOARD_KEY = ["provider", "benchmark", "version"]


def compare_reports(manifest: DataFrame, summaries: DataFrame) -> DataFrame:
    """Manifest rows (compare_id, provider, run_id, ord) with the summary of their run, if any."""
    return manifest.join(summaries, "run_id")


def provider_pivot(by_type: DataFrame, providers: Sequence[str]) -> DataFrame:
    """One row per question type, one accuracy column per provider, and the best provider.

    ``by_type`` is (question_type, provider, ord, accuracy). On ties the provider with the lowest
    ``ord`` is best; a provider without the type is null.
    """
    columns = [
        F.max(F.when(F.col("provider") == name, F.col("accuracy"))).alias(name) for name in providers
    ]
    best = F.max_by("provider", F.struct(F.col("accuracy"), (-F.col("ord")).alias("ord"))).alias("best")
    return by_type.groupBy("question_type").agg(*columns, best)


def question_types(by_type: DataFrame) -> DataFrame:
    """Every question type that occurs."""
    return by_type.select("question_type").distinct()


def winners(summary: DataFrame, latency: DataFrame) -> DataFrame:
    """Best flags per comparison: first best accuracy, and every provider at a phase's least mean.

    ``summary`` is (compare_id, provider, ord, accuracy), ``latency`` (compare_id, provider, ord,
    phase, mean). ``first_only`` marks the single row a display with one winner shows.
    """
    best = (
        summary.groupBy("compare_id").agg(
            F.max_by("provider", F.struct(F.col("accuracy"), (-F.col("ord")).alias("ord"))).alias("winner"))
        .select("compare_id", F.lit("accuracy").alias("measure"), F.col("winner").alias("provider"),
                F.lit(True).alias("first_only"))
    )
    least = latency.groupBy("compare_id", "phase").agg(
        F.min("mean").alias("mean"), F.min_by("provider", F.struct("mean", "ord")).alias("_first")
    )
    fast = latency.join(least, ["compare_id", "phase", "mean"]).select(
        "compare_id", F.col("phase").alias("measure"), "provider",
        (F.col("provider") == F.col("_first")).alias("first_only"),
    )
    return best.unionByName(fast)


def leaderboard_entries(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Board rows of fully evaluated runs.

    ``runs`` is (run_id, provider, benchmark, version, added_at), ``results`` (run_id, evaluated,
    score). A blank version becomes ``baseline``; accuracy divides by all questions.
    """
    done = results.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("evaluated")).alias("evaluated"),
        F.count_if(F.col("score") == 1).alias("correct"),
    ).where(F.col("evaluated") == F.col("total"))
    version = F.trim("version")
    return (
        runs.join(done, "run_id")
        .withColumn("version", F.when(version != "", version).otherwise("baseline"))
        .withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 4))
        .drop("evaluated")
    )


def leaderboard_upsert(board: DataFrame, new: DataFrame, version: str = "added_at",
                       tie: str = "run_id") -> DataFrame:
    """Replace entries on (provider, benchmark, version); new rows win over stored ones."""
    both = board.withColumn("_gen", F.lit(0)).unionByName(
        new.withColumn("_gen", F.lit(1)), allowMissingColumns=True
    )
    order = [F.col("_gen").desc(), F.col(version).desc(), F.col(tie).desc()]
    return first_row(both, BOARD_KEY, order).drop("_gen")


def leaderboard_rank(board: DataFrame, id_col: str = "id", id_block: int = 1_000_000) -> DataFrame:
    """Rank over the whole board by accuracy, then id.

    ``accuracy`` has four digits and ids are integers, so (accuracy, id block) cuts the board into
    ordered buckets that are ranked side by side.
    """
    return bucketed_row_number(
        board,
        [F.col("accuracy").desc(), F.col(id_col)],
        {"_acc": F.col("accuracy"), "_block": F.floor(F.col(id_col) / id_block)},
        [F.col("_acc").desc(), F.col("_block")],
    )


def board_with_types(board: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach the question-type registry (benchmark, type_id, alias, description) of each entry."""
    return board.join(registry, "benchmark", "left")

