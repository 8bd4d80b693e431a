"""The whole search of a query batch: rewrite, candidates, sub-queries, rerank, graph rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_counting_query
from .graph import graph_context
from .index import Index
from .search import bm25_top_k, effective_query, hybrid_search, merge_subqueries, rerank

# Fixed value: candidates fetched for a reranker.
OVERFETCH = 20


def _candidates(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, container, chunk_id, score, rank); by words alone where the queries carry no vectors."""
    if "embedding" in queries.columns:
        hits = hybrid_search(queries, index, k)
    else:
        hits = bm25_top_k(queries, index, k).withColumn("score", F.col("bm25"))
    return hits.select("query_id", "container", "chunk_id", "score", "rank")


def search(queries: DataFrame, index: Index, k: int = 10, rewrites: DataFrame | None = None,
           subqueries: DataFrame | None = None, rerank_scores: DataFrame | None = None,
           entities: DataFrame | None = None, edges: DataFrame | None = None, hops: int = 2,
           overfetch: int = OVERFETCH) -> DataFrame:
    """Result rows of every query (query_id, container, text[, embedding]) in order of ``pos``.

    ``rewrites`` (query_id, text) replace the text that is searched, not the one that is asked. Asked
    texts that count or list also use their ``subqueries`` (query_id, container, sub, text[,
    embedding]; sub from 1 on): a chunk keeps the row of the first that found it, and the union is
    sorted anew. With ``rerank_scores`` (query_id, pos, rerank; pos among the ``overfetch``
    candidates, from 0) more than ``k`` candidates are re-ordered. Chunk rows come first; with a graph
    follow the entities and dated relationships around the names that the asked text mentions, with
    score 0.
    """
    fetch = max(k, overfetch) if rerank_scores is not None else k
    asked = queries if rewrites is None else effective_query(queries, rewrites)
    hits = _candidates(asked, index, fetch)
    if subqueries is not None:
        counting = queries.where(is_counting_query(F.col("text"))).select("query_id", "container")
        key = ["query_id", "container"]
        parts = subqueries.join(counting, key, "left_semi")
        # A sub-query is searched under a name of its own.
        named = parts.withColumn("query_id", F.struct("query_id", F.col("sub").cast("bigint").alias("sub")))
        found = _candidates(named.drop("sub"), index, fetch).select(
            F.col("query_id.query_id").alias("query_id"), F.col("query_id.sub").alias("sub"), "container", "chunk_id",
            "score", "rank")
        every = hits.withColumn("sub", F.lit(0).cast("bigint")).unionByName(found)
        hits = merge_subqueries(every, fetch).drop("sub")
    hits = rerank(hits, rerank_scores, k) if rerank_scores is not None else hits.where(F.col("rank") <= k)
    chunks = hits.join(index.chunks.select("container", "chunk_id", "content"), ["container", "chunk_id"]).select(
        "query_id", "container", F.lit("chunk").alias("row_type"), "chunk_id", "content", "score",
        F.col("rank").alias("pos"))
    if entities is None or edges is None:
        return chunks
    around = graph_context(queries, entities, edges, hops)
    return chunks.unionByName(around, allowMissingColumns=True)
