"""Row filters, facets and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_contains(columns: Sequence[str], needle: str) -> Column:
    """Case-insensitive ``contains`` over several columns."""
    tests = [F.lower(F.col(c).cast("string")).contains(needle.lower()) for c in columns]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def status_is(status: Column, wanted: str) -> Column:
    """``pending`` means neither completed nor failed; an unknown name keeps every row."""
    if wanted in ("completed", "failed"):
        return F.coalesce(status == wanted, F.lit(False))
    if wanted == "pending":
        return ~F.coalesce(status.isin("completed", "failed"), F.lit(False))
    return F.lit(True)


def is_failure(label: Column, score: Column, strict: bool = True) -> Column:
    """Strict: labelled incorrect. Lenient: labelled incorrect or scored 0."""
    wrong = F.coalesce(label == "incorrect", F.lit(False))
    return wrong if strict else wrong | F.coalesce(score == 0, F.lit(False))


def filter_rows(df: DataFrame, search: str | None = None, search_cols: Sequence[str] = (),
                isin: Mapping[str, Sequence] | None = None, contains: Mapping[str, str] | None = None,
                status: str | None = None, status_col: str = "status", order: Sequence[str] = (),
                offset: int = 0, limit: int | None = None) -> DataFrame:
    """Search, facet, substring and status filters, then offset and limit in ``order``.

    An empty selection, a zero offset and a zero limit mean no filter.
    """
    if search:
        df = df.where(any_contains(search_cols, search))
    for column, values in (isin or {}).items():
        if values:
            df = df.where(F.col(column).isin(*values))
    for column, part in (contains or {}).items():
        df = df.where(F.col(column).contains(part.lower()))
    if status:
        df = df.where(status_is(F.col(status_col), status))
    if offset or limit:
        df = df.orderBy(*order)
        df = df.offset(offset) if offset else df
        df = df.limit(limit) if limit else df
    return df


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of rows with the total and the number of pages beside each row."""
    total = df.select(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.select("*", total.alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / size)
    )


def facet_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(facet, value, count)`` for several columns in one pass over the rows."""
    sets = F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return df.select(F.explode(sets).alias("_f")).groupBy("_f.facet", "_f.value").agg(
        F.count("*").alias("count")
    )
