"""The pluggable search back-end."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index, index_chunks
from .keyword import build_keyword_index, keyword_search
from .search import bm25_top_k, hybrid_search


class Retriever(Protocol):
    """Index chunks, then answer query batches with (query_id, container, chunk_id, score, rank)."""

    def index(self, chunks: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class _Indexed:
    table: Index

    def index(self, chunks: DataFrame) -> None:
        self.table = index_chunks(chunks)


class HybridRetriever(_Indexed):
    """Cosine and BM25 over every chunk (``full``) or over the nearest vectors (``candidates``)."""

    def __init__(self, mode: str = "full") -> None:
        self.mode = mode

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return hybrid_search(queries, self.table, k, mode=self.mode)


class Bm25Retriever(_Indexed):
    """BM25 only."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return bm25_top_k(queries, self.table, k).withColumn("score", F.col("bm25"))


class KeywordRetriever:
    """Term coverage with back-fill."""

    def index(self, chunks: DataFrame) -> None:
        self.table = build_keyword_index(chunks.select(
            "container", F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return keyword_search(queries, self.table, k).withColumnRenamed("doc_id", "chunk_id")


RETRIEVERS = {
    "hybrid": HybridRetriever,
    "hybrid_candidates": lambda: HybridRetriever("candidates"),
    "bm25": Bm25Retriever,
    "keyword": KeywordRetriever,
}
