"""Reading the named tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.batches import small_batches
from ..plans.scratch import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; any path that Spark can read."""
    small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later steps neither repeat it nor lose it with an
    executor."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A key with more than one of so many rows is joined apart, so at most that many keys are.
HOT_SHARE = 1000


def join_names(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` left join ``names`` (one row a key). Rows of hot keys stay where they are: these keys, at most HOT_SHARE
    of them whatever the data, are broadcast."""
    counted = rows.groupBy(key).count()
    total = counted.agg(F.sum("count")).first()[0] or 0
    hot = counted.where(F.col("count") * HOT_SHARE > total).where(F.col("count") > 1).select(key)
    hot = stored(hot.join(names, key, "left"), "hot")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names, key, "left")
    return cold.unionByName(rows.join(F.broadcast(hot), key))
