"""An index that is kept up batch by batch; stored rows are never rewritten by a batch.

A batch adds one part: ``rows``, its chunks with their terms counted; ``gone``, the keys of rows of earlier parts that it
replaces, each with its part; ``change``, what it adds to the statistics of each container. The list of parts is one
small file a state, written last: a job that dies before it leaves the former state in force, and what it wrote unread.

One writer at a time: a second one that starts from the same state fails when it writes the next.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import bm25_tokens, term_runs
from ..operators.index import Index
from ..plans.scratch import cut_lineage
from ..plans.skew import BROADCAST_ROWS, first_row, fits

KEY = ["container", "chunk_id"]
# Replaced keys are sent to the rows in at most so many broadcasts.
SENT_TURNS = 8
_STATE = ("columns STRING, parts ARRAY<STRUCT<name: STRING, n: BIGINT, gone: BIGINT, low: STRING, high: STRING>>, "
          "batches MAP<STRING, BIGINT>")
_COUNTED = "version BIGINT, deleted BOOLEAN, dl INT, terms ARRAY<STRUCT<term: STRING, tf: BIGINT, dl: INT>>, part STRING"
_CHANGE = "container STRING, n_docs BIGINT, total_len BIGINT"


@dataclass
class State:
    """What is in force: the chunk columns (DDL), the parts (name, n, gone, low, high) and the last batch of each writer."""

    number: int
    columns: str
    parts: list[Row]
    batches: dict[str, int] = field(default_factory=dict)


def create_kept(spark: SparkSession, path: str, columns: str = "container STRING, chunk_id STRING, content STRING") -> None:
    """An empty index of chunks with these columns; fails where there is one already."""
    _commit(spark, path, State(0, columns, []))


def kept_state(spark: SparkSession, path: str) -> State:
    """The newest state."""
    states = spark.read.schema(f"{_STATE}, state BIGINT").parquet(f"{path}/states")
    row = states.orderBy(F.col("state").desc()).first()
    return State(row.state, row.columns, row.parts, row.batches)


def _commit(spark: SparkSession, path: str, state: State) -> None:
    row = spark.createDataFrame([(state.columns, [tuple(p) for p in state.parts], state.batches)], _STATE)
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/states/state={state.number}")


def _key_schema(columns: str, spark: SparkSession) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], columns).schema}
    return ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", part STRING"


def _gone(spark: SparkSession, path: str, state: State) -> DataFrame | None:
    held = [p for p in state.parts if p.gone]
    if not held:
        return None
    return spark.read.schema(_key_schema(state.columns, spark)).parquet(*(f"{path}/parts/{p.name}/gone" for p in held))


def _standing(spark: SparkSession, path: str, state: State, parts: list[Row]) -> DataFrame:
    """Rows of the parts that no later part has replaced, deletion marks included."""
    rows = spark.read.schema(f"{state.columns}, {_COUNTED}").parquet(*(f"{path}/parts/{p.name}/rows" for p in parts))
    gone = _gone(spark, path, state)
    if gone is None:
        return rows
    turns = max(1, -(-sum(p.gone for p in state.parts) // BROADCAST_ROWS))
    if turns > SENT_TURNS:
        return rows.join(gone, [*KEY, "part"], "left_anti")
    # The rows hold texts and terms and stay where they are.
    for turn in range(turns):
        own = gone.where(F.pmod(F.xxhash64(*KEY), F.lit(turns)) == turn) if turns > 1 else gone
        rows = rows.join(F.broadcast(own), [*KEY, "part"], "left_anti")
    return rows


def _sums(rows: DataFrame, sign: int) -> DataFrame:
    return rows.where(~F.col("deleted")).select(
        "container", F.lit(sign).cast("bigint").alias("n_docs"), (F.col("dl") * sign).cast("bigint").alias("total_len"))


def _counted(rows: DataFrame) -> DataFrame:
    runs = term_runs(bm25_tokens(F.when(~F.col("deleted"), F.col("content"))))
    return rows.withColumn("terms", runs).withColumn("dl", F.coalesce(F.get("terms.dl", F.lit(0)), F.lit(0)))


def _write_part(spark: SparkSession, path: str, name: str, columns: Sequence[str], rows: DataFrame, gone: DataFrame,
                change: Callable[[DataFrame], DataFrame]) -> Row:
    """``rows`` with or without their terms; ``change`` is told the written ones."""
    at = f"{path}/parts/{name}"
    laid = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    # Counted where they come to lie: once, and neither the ranges' sample nor the shuffle holds terms.
    laid = laid if "terms" in rows.columns else _counted(laid)
    laid.select(*columns, "version", "deleted", "dl", "terms", F.lit(name).alias("part")).write.parquet(f"{at}/rows")
    gone.write.parquet(f"{at}/gone")
    change = change(spark.read.schema("container STRING, deleted BOOLEAN, dl INT").parquet(f"{at}/rows"))
    total = change.groupBy("container").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
    total.where("n_docs <> 0 OR total_len <> 0").write.parquet(f"{at}/change")
    size = spark.read.schema(rows.select("container").schema).parquet(f"{at}/rows").agg(
        F.count("*").alias("n"), F.min("container").alias("low"), F.max("container").alias("high")).first()
    lost = spark.read.schema(gone.schema).parquet(f"{at}/gone").count()
    return Row(name=name, n=size.n, gone=lost, low=size.low, high=size.high)


def _or_lit(batch: DataFrame, name: str, kind: str, default) -> Column:
    value = F.col(name).cast(kind) if name in batch.columns else F.lit(None).cast(kind)
    return F.coalesce(value, F.lit(default).cast(kind)).alias(name)


def add_batch(spark: SparkSession, path: str, batch: DataFrame, writer: str = "", batch_id: int | None = None) -> None:
    """Put the chunks of ``batch`` in force.

    Of several rows of one chunk the highest ``version`` counts (a missing one is the lowest), of equal ones the later batch,
    inside a batch a deletion, then a hash of the row. ``deleted`` rows take their chunk out; the mark stays, so an older
    version that comes late does not bring it back. Rows without container or chunk_id are no chunks. Columns the index
    does not have are left out, and absent ones are null. A (writer, batch_id) that is in force already changes nothing.

    Of stored rows only keys, versions and lengths are read, of parts whose containers overlap the batch's.
    """
    state = kept_state(spark, path)
    if batch_id is not None and state.batches.get(writer, -1) >= batch_id:
        return
    wanted = spark.createDataFrame([], state.columns).schema
    plain = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in batch.columns
             else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    rows = batch.select(*plain, _or_lit(batch, "version", "bigint", -(1 << 63)), _or_lit(batch, "deleted", "boolean", False))
    rows = rows.where(F.col("container").isNotNull() & F.col("chunk_id").isNotNull())
    content = F.xxhash64(*(f.name for f in wanted if f.dataType.typeName() != "map"))
    fresh = cut_lineage(first_row(rows, KEY, [F.col("version").desc(), F.col("deleted").desc(), content]))
    span = fresh.agg(F.min("container").alias("low"), F.max("container").alias("high")).first()
    parts = state.parts
    if span.low is not None:
        near = [p for p in state.parts if p.low is not None and p.low <= span.high and p.high >= span.low]
        stale = replaced = None
        if near:
            names = fresh.select(*KEY, F.col("version").alias("_version"))
            old = _standing(spark, path, state, near).where(F.col("container").between(span.low, span.high)).select(
                *KEY, "version", "deleted", "dl", "part")
            met = cut_lineage(old.join(F.broadcast(names) if fits(names) else names, KEY))
            stale = met.where(F.col("version") > F.col("_version")).select(*KEY)
            replaced = met.where(F.col("version") <= F.col("_version"))
        n_stale = stale.count() if stale is not None else 0
        if n_stale:
            fresh = fresh.join(F.broadcast(stale) if n_stale <= BROADCAST_ROWS else stale, KEY, "left_anti")
        if replaced is None:
            gone = spark.createDataFrame([], _key_schema(state.columns, spark))
        else:
            gone = replaced.select(*KEY, "part")

        def change(written: DataFrame) -> DataFrame:
            return _sums(written, 1) if replaced is None else _sums(written, 1).unionByName(_sums(replaced, -1))

        part = _write_part(spark, path, uuid.uuid4().hex, wanted.names, fresh, gone, change)
        # All rows may have been stale.
        parts = [*parts, part] if part.n else parts
    batches = state.batches if batch_id is None else {**state.batches, writer: batch_id}
    _commit(spark, path, State(state.number + 1, state.columns, parts, batches))


def merge_parts(spark: SparkSession, path: str, width: int = 8) -> bool:
    """Rewrite the smallest parts as one where ``width`` of them are of like size (the same power of ``width``).

    A row is thus rewritten once a power, and there are at most ``width`` parts a power. Returns whether it did.
    """
    state = kept_state(spark, path)
    tiers = defaultdict(list)
    for p in state.parts:
        tiers[int(math.log(max(p.n, 1), width) + 1e-9)].append(p)
    full = min((tier for tier, held in tiers.items() if len(held) >= width), default=None)
    if full is None:
        return False
    old = tiers[full]
    names = [p.name for p in old]
    wanted = spark.createDataFrame([], state.columns).schema.names
    rows = _standing(spark, path, state, old).select(*wanted, "version", "deleted", "dl", "terms")
    gone = _gone(spark, path, State(0, state.columns, old))
    if gone is None:
        gone = spark.createDataFrame([], _key_schema(state.columns, spark))
    change = spark.read.schema(_CHANGE).parquet(*(f"{path}/parts/{n}/change" for n in names))
    part = _write_part(spark, path, uuid.uuid4().hex, wanted, rows, gone.where(~F.col("part").isin(names)), lambda _: change)
    rest = [p for p in state.parts if p.name not in names]
    # Even where every row has been replaced since, what the parts took back and changed still holds.
    _commit(spark, path, State(state.number + 1, state.columns, [*rest, part], state.batches))
    return True


def read_kept(spark: SparkSession, path: str) -> Index:
    """The index in force; equal to ``index_chunks`` over its chunks, without counting any text again."""
    state = kept_state(spark, path)
    wanted = spark.createDataFrame([], state.columns).schema
    if state.parts:
        rows = _standing(spark, path, state, state.parts).where(~F.col("deleted"))
        change = spark.read.schema(_CHANGE).parquet(*(f"{path}/parts/{p.name}/change" for p in state.parts))
    else:
        rows = spark.createDataFrame([], f"{state.columns}, {_COUNTED}")
        change = spark.createDataFrame([], _CHANGE)
    forward = rows.select(*KEY, "dl", "terms")
    listed = forward.select(*KEY, F.inline("terms")).select("container", "term", "chunk_id", "dl", "tf")
    stats = change.groupBy("container").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
    stats = stats.where("n_docs > 0").withColumn("avgdl", F.col("total_len") / F.col("n_docs"))
    return Index(rows.select(*wanted.names), listed, stats, forward)


def keep_up(stream: DataFrame, path: str, checkpoint: str, width: int = 8) -> StreamingQuery:
    """Feed batches of a chunk stream to the index at ``path``, merging parts as they gather.

    The checkpoint names the writer, so a batch that is delivered again changes nothing.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        add_batch(spark, path, batch, writer, batch_id)
        while merge_parts(spark, path, width):
            pass

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
