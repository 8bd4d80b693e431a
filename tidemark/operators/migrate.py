"""Bringing data in from other stores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, trim_space
from ..plans.skew import first_row


def pivot_attributes(df: DataFrame, id_col: str, key: str, value: str, keys: Sequence[str],
                     where: dict[str, str] | None = None) -> DataFrame:
    """Rows of (id, key, value) to one row per id that has all ``keys``, in one shuffle.

    ``where`` fixes the value of some keys.
    """
    columns = [F.max(F.when(F.col(key) == name, F.col(value))).alias(name) for name in keys]
    wide = df.where(F.col(key).isin(*keys)).groupBy(id_col).agg(*columns)
    wide = wide.dropna(subset=list(keys))
    for name, wanted in (where or {}).items():
        wide = wide.where(F.col(name) == wanted)
    return wide


def compact_history(log: DataFrame) -> DataFrame:
    """Current memory texts of a change log (row_id, memory_id, new_memory, event, updated_at).

    The last non-null text of each memory that was never deleted, blank texts dropped, each text
    once with its earliest time.
    """
    latest = log.where(F.col("new_memory").isNotNull()).groupBy("memory_id").agg(
        F.max_by(F.struct("new_memory", "updated_at"), "row_id").alias("_last")
    )
    deleted = log.where(F.col("event") == "DELETE").select("memory_id").distinct()
    return (
        latest.join(deleted, "memory_id", "left_anti")
        .select("_last.new_memory", "_last.updated_at")
        .where(F.length(F.trim("new_memory")) > 0)
        .groupBy("new_memory").agg(F.min("updated_at").alias("updated_at"))
    )


def union_dedup(sources: Sequence[tuple[int, DataFrame]], text_col: str, order: Sequence[str]) -> DataFrame:
    """Union of sources; equal trimmed lower-case texts keep the row of the first source.

    Inside a source, the first row in ``order`` stays.
    """
    tagged = [df.withColumn("priority", F.lit(p)) for p, df in sources]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rows = rows.withColumn("content_hash", content_hash(F.col(text_col)))
    return first_row(rows, ["content_hash"], [F.col("priority"), *[F.col(c) for c in order]])


def drop_blank(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text has something besides white space."""
    return df.where(trim_space(F.col(text_col)) != "")


def chunk_ids(chunks: DataFrame, id_col: str, suffix: str = "_c") -> DataFrame:
    """Add ``sid``: the id, with a chunk suffix only where the text has more than one chunk.

    ``n_chunks`` must hold the number of chunks of the text.
    """
    base = F.col(id_col).cast("string")
    return chunks.withColumn("sid", F.when(F.col("n_chunks") == 1, base).otherwise(
        F.concat(base, F.lit(suffix), F.col("chunk_index").cast("string"))))
