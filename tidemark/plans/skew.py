"""Joins and top-k cuts that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
# Above this k Spark does not cut windows before the shuffle, so the salted form takes over.
WINDOW_LIMIT = 1000


def salted_join(small: DataFrame, large: DataFrame, keys: Sequence[str], spread: str,
                salts: int = SALTS) -> DataFrame:
    """Inner equi-join that splits every key of ``large`` over ``salts`` partitions.

    ``spread`` names a column of ``large`` whose hash picks the salt; ``small`` is copied to each.
    Every matching pair meets in exactly one salt.
    """
    left = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


# A side of at most this many narrow rows may be copied to every task.
BROADCAST_ROWS = 500_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def measured_join(small: DataFrame, large: DataFrame, keys: Sequence[str], spread: str,
                  fit: bool) -> DataFrame:
    """Broadcast ``small`` if it was measured to fit, so that ``large`` stays where it is; else
    split every key over salts."""
    if fit:
        return large.join(F.broadcast(small), list(keys))
    return salted_join(small, large, keys, spread)


def spread_few_files(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan of fewer files than cores; larger scans stay as they are.

    A single file may be one row group, which one task reads whole.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(*keys) if len(df.inputFiles()) < cores else df


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank", spread: str | None = None, salts: int = SALTS) -> DataFrame:
    """First ``k`` rows of each ``by`` group, numbered from 1 in ``rank``.

    Spark cuts to ``k`` before the shuffle for small ``k``. For larger ``k`` a first cut per
    ``spread`` salt bounds what one task sorts; the top k of a group is among the top k of its
    salts, so the result is the same.
    """
    if k > WINDOW_LIMIT and spread is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        first = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop(
            "_rn", "_salt"
        )
    w = Window.partitionBy(*by).orderBy(*order)
    # The cast follows the cut: Spark recognises only a plain row number.
    kept = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    return kept.withColumn(rank, F.col(rank).cast("bigint"))


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group; each map task sends at most one row per group it holds."""
    return top_k(df, by, order, 1, "_first").drop("_first")
