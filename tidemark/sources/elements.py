"""Elements of JSON array files, several tasks a file.

Spark's text reader cuts a file of any size at closing braces, so its own file splits do the work. A brace cannot be told
from one inside a string without all that stands before, hence two passes: the first notes for each split, for both
answers to "does it begin inside a string?", how quotes, depth and commas change; running sums over these few rows say how
each split really begins; the second cuts elements. Only elements that lie in two splits are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.scratch import cut_lineage

CORRUPT = "_unreadable"
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")] = 1
_STEP[list(b"]}")] = -1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, dict]]:
    """Text of neighbouring pieces of one split, each with the brace that ended it, and the other columns of the first."""
    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or blocks[i] != blocks[at] or files[i] != files[at]:
                rest = {name: batch.column(name)[at].as_py() for name in batch.schema.names[3:]}
                yield (files[at], blocks[at]), b"}".join(values[at:i]) + b"}", rest
                at = i


def _outside(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Characters with escapes blotted out, and for each the parity of the quotes up to it."""
    chars = np.frombuffer(_ESCAPED.sub(b"xx", data), np.uint8)
    return chars, np.cumsum(chars == ord('"')) & 1


_SUMMARY = ("file STRING, block BIGINT, first STRING, n BIGINT, quotes INT, depth ARRAY<BIGINT>, "
            "commas ARRAY<MAP<INT, BIGINT>>")


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: the change of depth, and the commas of each relative depth, for both ways to begin."""
    def row(key: tuple, now: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [dict(zip(("file", "block"), key)) | now | {"commas": [list(c.items()) for c in now["commas"]]}], schema=schema)

    entries = pa.map_(pa.int32(), pa.int64())
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("n", pa.int64()),
                        ("quotes", pa.int32()), ("depth", pa.list_(pa.int64())), ("commas", pa.list_(entries))])
    key, now = None, None
    for at, data, _ in _by_block(batches):
        if at != key:
            if key:
                yield row(key, now)
            key, now = at, {"first": "", "n": 0, "quotes": 0, "depth": [0, 0], "commas": [{}, {}]}
        chars, quoted = _outside(data)
        now["first"] = now["first"] or data.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1")
        now["n"] += len(data)
        for begin in (0, 1):
            out = (quoted ^ now["quotes"] ^ begin) == 0
            depth = np.cumsum(np.where(out, _STEP[chars], 0)) + now["depth"][begin]
            for level, n in zip(*np.unique(depth[out & (chars == ord(","))], return_counts=True)):
                now["commas"][begin][int(level)] = now["commas"][begin].get(int(level), 0) + int(n)
            now["depth"][begin] = int(depth[-1])
        now["quotes"] ^= int(quoted[-1])
    if key:
        yield row(key, now)


def _begins(summary: DataFrame) -> DataFrame:
    """How each split begins: inside a string or not, depth, elements before it, and whether its file ends whole."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")

    def sum_before(column: str):
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    said = summary.withColumn("quoted", (sum_before("quotes") % 2).cast("int"))
    said = said.withColumn("step", F.get("depth", F.col("quoted"))).withColumn("seen", F.get("commas", F.col("quoted")))
    # A file holds one array, whose elements lie one level deep, or one object.
    said = said.withColumn("base", F.when(F.min_by("first", "block").over(whole) == "[", 1).otherwise(0))
    said = said.withColumn("at", sum_before("step"))
    found = F.coalesce(F.element_at("seen", (F.col("base") - F.col("at")).cast("int")), F.lit(0))
    said = said.withColumn("here", F.when(F.col("base") == 1, found).otherwise(0))
    ended = (F.sum("step").over(whole) <= 0) & (F.sum("quotes").over(whole) % 2 == 0)
    return said.select("file", "block", "quoted", F.col("at").alias("depth"), sum_before("here").alias("ord"), "base",
                       ended.alias("ended"), "n")


_CUT = "file STRING, block BIGINT, ord BIGINT, part INT, head BOOLEAN, whole BOOLEAN, value BINARY"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole elements, and parts of those that go on from or into another split."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ord", pa.int64()), ("part", pa.int32()),
                        ("head", pa.bool_()), ("whole", pa.bool_()), ("value", pa.binary())])

    def row(key: tuple, ord_: int, part: int, head: bool, whole: bool, value: bytes) -> dict:
        return {"file": key[0], "block": key[1], "ord": ord_, "part": part, "head": head, "whole": whole, "value": value}

    def checked(key: tuple, read: int, told: dict) -> None:
        if read != told["n"]:
            raise ValueError(f"{key[0]} changed, or its splits did, between two passes over it")

    key, told, kept, head, rows = None, None, [], False, []
    for at, data, rest in _by_block(batches):
        if rest["n"] is None:
            raise ValueError(f"the splits of {at[0]} changed between two passes over it; set spark.sql.files.minPartitionNum")
        if at != key:
            if key:
                checked(key, read, told)
                if kept:
                    rows.append(row(key, ord_, 1, head, False, b"".join(kept)))
            key, told, read = at, rest, 0
            quotes, depth, ord_, base = rest["quoted"], rest["depth"], rest["ord"], rest["base"]
            # An element is open where the split begins below the level of elements.
            inside, kept, head = depth > base, [], False
        read += len(data)
        if not rest["ended"]:
            continue
        chars, quoted = _outside(data)
        out = (quoted ^ quotes) == 0
        levels = np.cumsum(np.where(out, _STEP[chars], 0)) + depth
        commas = np.flatnonzero(out & (chars == ord(",")) & (levels == base)) if base else np.empty(0, np.int64)
        starts = np.flatnonzero(out & (chars == ord("{")) & (levels == base + 1))
        ends = np.flatnonzero(out & (chars == ord("}")) & (levels == base))
        places = ord_ + np.searchsorted(commas, ends)
        done = 0
        for end, place in zip(ends.tolist(), places.tolist()):
            if inside:
                kept.append(data[:end + 1])
                rows.append(row(key, place, 0, head, head, b"".join(kept)))
                inside, kept = False, []
            else:
                rows.append(row(key, place, 0, True, True, data[starts[done]:end + 1]))
                done += 1
        if inside:
            kept.append(data)
        elif done < len(starts):
            inside, head, kept = True, True, [data[starts[done]:]]
        quotes, depth, ord_ = quotes ^ int(quoted[-1]), int(levels[-1]), ord_ + len(commas)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if key:
        checked(key, read, told)
        if kept:
            rows.append(row(key, ord_, 1, head, False, b"".join(kept)))
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, ord, value)``: the objects of the one JSON array of each file, with their place in it from 0.

    A file that is one object is one element. Elements that are no objects hold their place and are left out. A file whose
    array does not end is not read and gives one row with null ``ord`` and ``value``; an empty file gives none. The
    elements are stored in the shared folder, so the tables made of them do not read the files again.
    """
    pieces = _pieces(spark, path)
    begins = cut_lineage(_begins(pieces.mapInArrow(_summarise, _SUMMARY)))
    # One row of a few numbers a file split: 100 TB have under a million.
    cut = pieces.join(F.broadcast(begins), ["file", "block"], "left").select(*pieces.columns, *begins.columns[2:]).mapInArrow(_cut, _CUT)
    cut = cut_lineage(cut.withColumn("value", F.col("value").cast("string")))
    parts = F.sort_array(F.collect_list(F.struct("block", "part", "value")))
    joined = cut.where("NOT whole").groupBy("file", "ord").agg(F.bool_or("head").alias("head"), parts.alias("parts")).where(
        "head").select("file", "ord", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    broken = begins.where("NOT ended").select("file").distinct().select(
        "file", F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("value"))
    return cut.where("whole").select("file", "ord", "value").unionByName(cut_lineage(joined.unionByName(broken)))


def parsed(elements: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Elements read by ``schema``, as columns beside ``file`` and ``ord``; and those that cannot be read, as they are."""
    fields = StructType.fromDDL(f"{schema}, {CORRUPT} STRING")
    read = elements.withColumn("_e", F.from_json("value", fields, {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("value").isNull() | F.col(f"_e.{CORRUPT}").isNotNull()
    return read.where(~bad).select("file", "ord", "_e.*").drop(CORRUPT), read.where(bad).select("file", "ord", "value")
