"""Batch inference with a caller's function, and offline stand-ins for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import parse_json_array, parse_verdict
from ..functions.text import plain_tokens

BATCH = 100


def infer(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], input_cols: Sequence[str],
          schema: str | T.StructType, batch: int = BATCH) -> DataFrame:
    """Apply ``fn`` to row batches of at most ``batch`` rows, in parallel over the partitions.

    ``fn`` gets the ``input_cols`` and returns a frame with the columns of ``schema``.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                yield fn(frame.iloc[start:start + batch].reset_index(drop=True))

    return df.select(*input_cols).mapInPandas(run, schema)


def hashed_embedding(texts: pd.Series, width: int = 64) -> list[np.ndarray]:
    """Unit bag-of-words vectors by token hash: a stand-in for an embedding model."""
    out = []
    for text in texts:
        vector = np.zeros(width, dtype=np.float32)
        for token in "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split():
            digest = hashlib.md5(token.encode()).digest()
            vector[int.from_bytes(digest[:4], "little") % width] += 1.0 if digest[4] & 1 else -1.0
        norm = float(np.linalg.norm(vector))
        out.append(vector / norm if norm else vector)
    return out


def embed(df: DataFrame, text_col: str, fn: Callable[[pd.Series], list] | None = None,
          batch: int = BATCH) -> DataFrame:
    """Add ``embedding`` from ``fn``, called with at most ``batch`` texts at a time."""
    model = fn or hashed_embedding
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(embedding=model(frame[text_col]))

    return infer(df, add, df.columns, schema, batch)


def containment_judge(truth: Column, hypothesis: Column) -> Column:
    """Stand-in verdict: 1 when the answer holds the expected words in a row."""
    def norm(c: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(plain_tokens(c), " "), F.lit(" "))

    return F.when((F.size(plain_tokens(truth)) > 0) & norm(hypothesis).contains(norm(truth)), 1).otherwise(0)


def judge(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], input_cols: Sequence[str],
          key: str = "question_id", batch: int = BATCH) -> DataFrame:
    """Verdicts from a caller's judge, which returns ``(key, reply)``."""
    schema = T.StructType([df.schema[key], T.StructField("reply", T.StringType())])
    replies = infer(df, fn, input_cols, schema, batch)
    return replies.select(key, parse_verdict(F.col("reply")).alias("_v")).select(key, "_v.*")


def relevance_labels(replies: DataFrame, key: str = "query_id", reply: str = "reply") -> DataFrame:
    """Labels ``(key, result_id, relevant)`` from replies holding a JSON array; bad replies give none."""
    rows = parse_json_array(F.col(reply), "struct<id:string,relevant:int>")
    return replies.select(key, F.explode(rows).alias("_r")).select(
        key, F.col("_r.id").alias("result_id"),
        F.when(F.col("_r.relevant") == 1, 1).otherwise(0).alias("relevant"))
