"""BM25, vector and hybrid ranking of chunks for a batch of queries.

Queries are ``(query_id, container, text[, embedding])``; a query only sees its own container.
Scores are rounded to six digits before ranking and ties go to the lower chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from ..plans.scratch import cut_lineage
from ..plans.skew import first_row, fits, top_k
from .blockmax import bm25_scores
from .blocks import block_top_k, streamed_top_k
from .index import Index

# Ranking constants.
K1 = 1.2
B = 0.75
VECTOR_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3

DIGITS = 6


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, container, term, qtf)``: a term repeated in a query counts once per use."""
    return (
        queries.select("query_id", "container", F.explode(bm25_tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "container", "term")
        .agg(F.count("*").alias("qtf"))
    )


def bm25_raw(queries: DataFrame, index: Index, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, container, chunk_id, bm25_raw)`` for every chunk that shares a term."""
    return bm25_scores(query_terms(queries), index, k1, b)


def bm25(queries: DataFrame, index: Index, normalise: bool = True, k1: float = K1,
         b: float = B) -> DataFrame:
    """BM25 per matching (query, chunk); ``bm25`` is divided by the query's best score."""
    raw = bm25_raw(queries, index, k1, b)
    if not normalise:
        return raw
    # Read twice, for the best score and for the rows: stored once instead of scored twice.
    raw = cut_lineage(raw)
    best = cut_lineage(raw.groupBy("query_id", "container").agg(F.max("bm25_raw").alias("_best")))
    # One row a query; the scored rows, many more, stay where they are.
    return raw.join(F.broadcast(best) if fits(best) else best, ["query_id", "container"]).withColumn(
        "bm25", F.coalesce(F.try_divide("bm25_raw", "_best"), F.lit(0.0))
    ).drop("_best")


def bm25_top_k(queries: DataFrame, index: Index, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """Best ``k`` chunks per (query, container) by BM25, with the normalised score beside it.

    Only chunks that block maxima leave in reach of the first ``k`` are scored (``blockmax``). The best
    score of a query is its rank-1 row, so only the kept rows are normalised.
    """
    raw = bm25_scores(query_terms(queries), index, k1, b, k).withColumn("bm25_raw", F.round("bm25_raw", DIGITS))
    kept = top_k(raw, ["query_id", "container"], [F.col("bm25_raw").desc(), F.col("chunk_id")], k,
                 spread="chunk_id")
    best = F.max("bm25_raw").over(Window.partitionBy("query_id", "container"))
    return kept.withColumn(
        "bm25", F.coalesce(F.round(F.try_divide(F.col("bm25_raw"), best), DIGITS), F.lit(0.0))
    )


def _rank(df: DataFrame, k: int) -> DataFrame:
    return top_k(df, ["query_id", "container"], [F.col("score").desc(), F.col("chunk_id")], k,
                 spread="chunk_id")


def _shown(df: DataFrame) -> DataFrame:
    """Parts of a score rounded for output; ranking used the unrounded parts."""
    return df.withColumns({c: F.round(c, DIGITS) for c in ("vector", "bm25")})


def _nearest(queries: DataFrame, chunks: DataFrame, k: int, broadcast_bytes: int = 64 << 20) -> DataFrame:
    scored = streamed_top_k(queries, chunks, k, 1.0, broadcast_bytes)
    if scored is None:
        scored = block_top_k(queries, chunks, None, k, 1.0, 0.0)
    return _rank(scored, k)


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20,
                 broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Best ``k`` chunks per query by cosine.

    Query vectors are shipped to the chunk partitions when they measure below
    ``broadcast_bytes``; the chunks are then not shuffled at all. Larger batches are compared block
    by block.
    """
    return _shown(_nearest(queries, chunks, k, broadcast_bytes)).select(
        "query_id", "container", "chunk_id", "vector", "rank")


def hybrid_search(queries: DataFrame, index: Index, k: int = 20, w_vec: float = VECTOR_WEIGHT,
                  w_kw: float = KEYWORD_WEIGHT, mode: str = "full") -> DataFrame:
    """Weighted sum of cosine and normalised BM25.

    ``full`` scores every chunk of the container. ``candidates`` takes the ``k`` nearest vectors
    first and normalises BM25 over those only, as a SQL store would. A query without a vector is
    scored by its words alone, with cosine 0 and its best BM25 as 1.
    """
    wordy = queries.where(F.col("embedding").isNull())
    queries = queries.where(F.col("embedding").isNotNull())
    if mode == "candidates":
        near = _nearest(queries, index.chunks, k).drop("bm25", "score", "rank")
        raw = bm25_raw(queries, index)
        rows = near.join(raw, ["query_id", "container", "chunk_id"], "left").withColumn(
            "bm25_raw", F.coalesce("bm25_raw", F.lit(0.0))
        )
        best = F.max("bm25_raw").over(Window.partitionBy("query_id", "container"))
        rows = rows.withColumn("bm25", F.coalesce(F.try_divide(F.col("bm25_raw"), best), F.lit(0.0))).drop("bm25_raw")
        rows = rows.withColumn("score", F.round(w_vec * F.col("vector") + w_kw * F.col("bm25"), DIGITS))
        return _shown(_rank(rows.unionByName(_by_words(bm25(wordy, index), w_kw)), k))
    if mode != "full":
        raise ValueError(f"unknown mode {mode!r}")
    every = bm25(queries.unionByName(wordy), index)
    key = ["query_id", "container"]
    pairs = every.join(queries.select(*key), key, "left_semi").select(*key, "chunk_id", "bm25")
    lone = _by_words(every.join(wordy.select(*key), key, "left_semi"), w_kw)
    rows = block_top_k(queries, index.chunks, pairs, k, w_vec, w_kw)
    return _shown(_rank(rows.select(*lone.columns).unionByName(lone), k))


def _by_words(pairs: DataFrame, w_kw: float) -> DataFrame:
    """Scored rows of queries without a vector."""
    return pairs.select("query_id", "container", "chunk_id", F.lit(0.0).alias("vector"), "bm25",
                        F.round(w_kw * F.col("bm25"), DIGITS).alias("score"))


def with_chunk_columns(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Attach chunk columns to ranked rows; only the kept rows meet the chunk texts."""
    return hits.join(chunks.select("container", "chunk_id", *columns), ["container", "chunk_id"])


def rerank(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Re-order candidates by outside scores ``(query_id, pos, rerank)``; ``pos`` counts from 0.

    A candidate without a score gets 0. Queries without any score row, or with no more than ``k``
    candidates, keep their order and scores.
    """
    # A later score for the same position replaces an earlier one; equal rows collapse.
    one = scores.groupBy("query_id", "pos").agg(F.max("rerank").alias("rerank"))
    scored = one.select("query_id").distinct().withColumn("_scored", F.lit(True))
    per_query = Window.partitionBy("query_id", "container")
    rows = (
        hits.withColumn("pos", F.col("rank") - 1)
        .join(one, ["query_id", "pos"], "left")
        .join(scored, "query_id", "left")
        .withColumn("_n", F.count("*").over(per_query))
        .withColumn("_use", F.coalesce(F.col("_scored"), F.lit(False)) & (F.col("_n") > k))
        .withColumn("rerank_score", F.when(F.col("_use"), F.coalesce(F.col("rerank"), F.lit(0)).cast("double")))
    )
    rows = rows.withColumn(
        "score", F.when(F.col("_use"), F.col("rerank_score") / 10).otherwise(F.col("score"))
    )
    order = [F.coalesce("rerank_score", F.lit(0.0)).desc(), F.col("pos")]
    return top_k(rows.drop("rank"), ["query_id", "container"], order, k).drop(
        "pos", "rerank", "_scored", "_n", "_use"
    )


def merge_subqueries(hits: DataFrame, k: int) -> DataFrame:
    """Union of sub-query results ``(query_id, container, sub, chunk_id, score, rank)``.

    A chunk keeps the row of the first sub-query that found it; the union is re-sorted by score and
    cut. Scores stay as each sub-query gave them.
    """
    once = first_row(hits, ["query_id", "container", "chunk_id"], [F.col("sub"), F.col("rank")])
    return _rank(once.drop("rank"), k)


def effective_query(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Use a rewritten text where it exists, is not blank and has at most 500 characters."""
    new = rewrites.select("query_id", F.trim("text").alias("_new"))
    usable = (F.length("_new") > 0) & (F.length("_new") <= 500)
    return queries.join(new, "query_id", "left").withColumn(
        "text", F.when(usable, F.col("_new")).otherwise(F.col("text"))
    ).drop("_new")


def result_rows(df: DataFrame, content: Column, score: Column, kind: Column) -> DataFrame:
    """Public result columns with defaults: empty content, score 0, type ``chunk``."""
    return df.withColumns({
        "content": F.coalesce(content, F.lit("")),
        "score": F.coalesce(score, F.lit(0.0)),
        "row_type": F.coalesce(kind, F.lit("chunk")),
    })
