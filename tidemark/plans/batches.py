"""Arrow batches of bounded size: what a Python worker holds does not grow with the rows a task reads."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Rows of an Arrow batch: a row that holds a text's words is thousands of bytes and up, so Spark's default of 10,000 rows
# is too many to hold several batches a core.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session hand on smaller Arrow batches, unless it was told a size of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)


def steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of rows with these sizes; all but a run's last row together stay under ``most``."""
    before = np.cumsum(sizes) - sizes
    edges = np.flatnonzero(np.diff(before // most, prepend=-1)).tolist()
    yield from zip(edges, [*edges[1:], len(sizes)][:len(edges)], strict=True)


def gathered(batches: Iterable[pa.RecordBatch], rows: int, nbytes: int) -> Iterator[pa.Table]:
    """Batches put together until they hold so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= nbytes:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)
