"""Ordered per-key scans split by a coarse order bucket.

A window over one key sorts all of that key's rows in one task. Here the key is split by a bucket
of the order column (a day, say): each (key, bucket) is scanned on its own, one summary row per
(key, bucket) is scanned across buckets, and the carry is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_last(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
               value: Column, name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row of its key, as column ``name``."""
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    scanned = tagged.withColumn(
        "_seen", F.last("_value", ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    ends = tagged.where(F.col("_value").isNotNull()).groupBy(*keys, "_bucket").agg(
        F.max_by("_value", F.struct(*order)).alias("_end")
    )
    # Buckets without a value take part too: they need the carry of the buckets before them.
    summary = tagged.select(*keys, "_bucket").distinct().join(ends, [*keys, "_bucket"], "left")
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, "_bucket", F.last("_end", ignorenulls=True).over(across).alias("_carry")
    )
    return (
        scanned.join(carried, [*keys, "_bucket"], "left")
        .withColumn(name, F.coalesce("_seen", "_carry"))
        .drop("_bucket", "_value", "_seen", "_carry")
    )


def gap_runs(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: float,
             bucket: Column) -> DataFrame:
    """Number each row inside its run: a run ends where the next row is ``gap_seconds`` away or more.

    Adds ``run_start`` (timestamp of the first row of the run) and ``run_pos`` (from 1).
    """
    keys = list(keys)
    order = [F.col(ts), F.col(tie)]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    tagged = df.withColumn("_bucket", bucket).withColumn("_us", micros)
    part = Window.partitionBy(*keys, "_bucket")
    inside = part.orderBy(*order)

    edges = tagged.groupBy(*keys, "_bucket").agg(F.max("_us").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = edges.select(*keys, "_bucket", F.lag("_last").over(across).alias("_before"))

    limit = int(gap_seconds * 1_000_000)
    started = (
        tagged.join(edges, [*keys, "_bucket"])
        .withColumn("_prev", F.coalesce(F.lag("_us").over(inside), F.col("_before")))
        .withColumn("_new", F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= limit))
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn("_mark", F.when(F.col("_new"), F.struct(F.col("_us"), F.col("_rn"))))
        .withColumn("_own", F.last("_mark", ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    # What a bucket hands on: the start of its last run and how many rows that run has so far.
    ends = started.groupBy(*keys, "_bucket").agg(
        F.count("*").alias("_size"), F.max("_mark").alias("_mark")
    )
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = across.rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        ends.withColumn("_cum", F.sum("_size").over(upto))
        # rows of the key before the run that is open at the end of this bucket
        .withColumn("_base", F.when(F.col("_mark").isNotNull(),
                                    F.struct(F.col("_mark._us").alias("us"),
                                             (F.col("_cum") - F.col("_size") + F.col("_mark._rn") - 1)
                                             .alias("rows"))))
        .select(*keys, "_bucket", (F.col("_cum") - F.col("_size")).alias("_rows_before"),
                F.last("_base", ignorenulls=True).over(past).alias("_open"))
    )
    return (
        started.join(ends, [*keys, "_bucket"])
        .withColumn("run_start", F.timestamp_micros(F.coalesce(F.col("_own._us"), F.col("_open.us"))))
        .withColumn("run_pos", F.when(F.col("_own").isNotNull(), F.col("_rn") - F.col("_own._rn") + 1)
                    .otherwise(F.col("_rows_before") + F.col("_rn") - F.col("_open.rows")))
        .drop("_bucket", "_us", "_before", "_prev", "_new", "_rn", "_mark", "_own",
              "_rows_before", "_open")
    )

