"""Choosing questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import top_k


def sample_questions(df: DataFrame, mode: str = "full", per_category: int | None = None,
                     limit: int | None = None, seed: int | None = None,
                     type_col: str = "question_type", pos: str = "pos", id_col: str = "question_id"
                     ) -> DataFrame:
    """``full``, the first ``limit`` by position, or ``per_category`` rows of each type.

    Rows of a type are taken by position, or with ``seed`` in a repeatable random order.
    """
    if mode == "limit" and limit:
        return df.orderBy(pos).limit(limit)
    if mode == "sample" and per_category:
        if seed is None:
            order = [F.col(pos)]
        else:
            order = [F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))), F.col(id_col)]
        return top_k(df, [type_col], order, per_category, "_pick", spread=id_col).drop("_pick")
    return df
