"""Retrieval metrics per question and their means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(questions: DataFrame, hits: DataFrame, labels: DataFrame, k: int = 10,
                      truth: DataFrame | None = None) -> DataFrame:
    """One metrics row per question.

    ``hits`` is (query_id, chunk_id, rank), ``labels`` (query_id, chunk_id, relevant); only 1 counts
    as relevant. ``recall_at_k_ref`` equals the hit flag; ``recall_at_k`` is the share of the known
    relevant rows ``truth`` (query_id, n_relevant) that was found, null without ``truth``.
    Questions without rows get zeros, ``k`` = 0 and ``total_relevant`` = 1.
    """
    # One label per (query, row), so that repeats cannot multiply hits.
    one = labels.groupBy("query_id", "chunk_id").agg(F.max("relevant").alias("relevant"))
    rows = hits.where(F.col("rank") <= k).join(one, ["query_id", "chunk_id"], "left").withColumn(
        "_rel", F.when(F.coalesce("relevant", F.lit(0)) == 1, 1).otherwise(0)
    )
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    per = rows.groupBy("query_id").agg(
        F.count("*").alias("k"),
        F.sum("_rel").alias("relevant_retrieved"),
        F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("_first"),
        F.sum(F.col("_rel") * gain).alias("_dcg"),
    )
    zero = F.lit(0).cast("bigint")
    per = questions.select("query_id").join(per, "query_id", "left").withColumns({
        "k": F.coalesce("k", zero),
        "relevant_retrieved": F.coalesce("relevant_retrieved", zero),
    })
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("relevant_retrieved"), F.col("k")), F.lit(1)).cast("int")),
        F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0),
    )
    hit = (F.col("relevant_retrieved") > 0).cast("double")
    precision = F.coalesce(F.try_divide("relevant_retrieved", "k"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * hit, precision + hit), F.lit(0.0))
    out = per.select(
        "query_id", hit.alias("hit_at_k"), F.round(precision, 6).alias("precision_at_k"),
        hit.alias("recall_at_k_ref"), F.round(f1, 6).alias("f1_at_k"),
        F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("_dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
        "k", "relevant_retrieved",
        F.greatest(F.col("relevant_retrieved"), F.lit(1)).alias("total_relevant"),
    )
    if truth is None:
        return out.withColumn("recall_at_k", F.lit(None).cast("double"))
    return out.join(truth, "query_id", "left").withColumn(
        "recall_at_k", F.round(F.try_divide("relevant_retrieved", "n_relevant"), 6)
    ).drop("n_relevant")


MEAN_COLUMNS = ("hit_at_k", "precision_at_k", "recall_at_k_ref", "f1_at_k", "mrr", "ndcg")


def retrieval_means(metrics: DataFrame, by: Sequence[str] = (), order: str = "query_id") -> DataFrame:
    """Mean of each metric; ``k`` is that of the last record in ``order``. No rows, no result row."""
    means = [F.round(F.avg(c), 6).alias(c) for c in MEAN_COLUMNS]
    return metrics.groupBy(*by).agg(
        *means, F.max_by("k", order).alias("k"), F.count("*").alias("n")
    ).where(F.col("n") > 0)
