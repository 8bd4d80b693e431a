"""Exact order statistics and row numbers without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_positions(df: DataFrame, by: Sequence[str], value: str,
                    fractions: Mapping[str, float]) -> DataFrame:
    """Value at 0-based position ``floor(n * fraction)`` of each sorted group; values must be > 0.

    Equal values are counted before the shuffle. Counts per logarithmic bucket locate the bucket of
    every position, and only those buckets are sorted.
    """
    by = list(by)
    hist = df.groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn(
        "_bucket", F.floor(F.log2(F.col(value)) * 64).cast("int")
    )
    per_group = Window.partitionBy(*by)
    upto = per_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in fractions.items()
    ])
    wanted = (
        hist.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_size"))
        .withColumn("_hi", F.sum("_size").over(upto))
        .withColumn("_total", F.sum("_size").over(per_group))
        .withColumn("_mark", F.explode(marks))
        .withColumn("_pos", F.floor(F.col("_total") * F.col("_mark.p")))
        .where((F.col("_pos") < F.col("_hi")) & (F.col("_pos") >= F.col("_hi") - F.col("_size")))
        .select(*by, "_bucket", F.col("_mark.name").alias("_name"),
                (F.col("_pos") - F.col("_hi") + F.col("_size")).alias("_pos"))
    )
    inside = Window.partitionBy(*by, "_bucket", "_name").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = (
        hist.join(wanted, [*by, "_bucket"])
        .withColumn("_upto", F.sum("_n").over(inside))
        .where((F.col("_pos") < F.col("_upto")) & (F.col("_pos") >= F.col("_upto") - F.col("_n")))
    )
    picked = [F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in fractions]
    return found.groupBy(*by).agg(*picked)


def bucketed_row_number(df: DataFrame, order: Sequence[Column], buckets: Mapping[str, Column],
                        bucket_order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row number over the whole frame, sorted bucket by bucket.

    ``buckets`` are coarse keys that follow ``order`` (all rows of a bucket come before those of the
    next); the first of them must have few values, as a four-digit accuracy has. Bucket sizes give
    each bucket its offset, so no task sorts more than one bucket.
    """
    keys = list(buckets)
    tagged = df.withColumns(dict(buckets))
    sizes = tagged.groupBy(*keys).agg(F.count("*").alias("_size"))
    # Offsets of the first key's values, then of the buckets inside each: no task sees all buckets.
    lead, rest = bucket_order[0], list(bucket_order[1:])
    heads = sizes.groupBy(keys[0]).agg(F.sum("_size").alias("_whole"))
    past = Window.orderBy(lead).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(keys[0], F.coalesce(F.sum("_whole").over(past), F.lit(0)).alias("_base"))
    before = Window.partitionBy(keys[0]).orderBy(*(rest or [lead])).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_in", F.coalesce(F.sum("_size").over(before), F.lit(0))).join(heads, keys[0]).select(
        *keys, (F.col("_base") + F.col("_in")).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_rn", "_offset", *keys)
    )
