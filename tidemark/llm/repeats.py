"""Removal of long repeated byte strings: every byte under a string of LENGTH bytes that starts anywhere else too.

Anchors. A string's anchor is the place of the least 8-byte hash among its first WINDOW places, the last one on a tie.
Equal strings have their anchors at equal places, so they share the MIDDLE bytes from the anchor on, which every string
with that anchor covers. Bytes whose anchor's middle occurs once are no repeats.

Anchors with a common middle form a group. Its members' contexts (SIDE bytes before the anchor, the middle as one
symbol, SIDE bytes after the middle) are ordered column by column (see columnsort); neighbours that share WINDOW symbols
from a column on are two starts of one repeated string. Equal contexts are settled before by one hash and go in once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import salted_join
from .columnsort import rounds
from .kernels import Rolling, mix, text_slices
from .tables import HOT_SHARE, stored

LENGTH = 400
WINDOW = 192
SIDE = WINDOW - 1
MIDDLE = LENGTH - SIDE
GRAM = 8
# Bits of a packed minimum that hold the place; texts over BLOCK + LENGTH bytes are read in overlapping blocks of that size.
PLACE = 24
BLOCK = 1 << 23
# Contexts that are ordered together; whole groups, unless one is larger.
TOGETHER = 16_384
# A group with more different contexts is settled by the hashes of its strings instead, spread over all tasks.
HEAVY = 100_000
PAD = 256


def _least(data: np.ndarray) -> np.ndarray:
    """For each place, the anchor of the string that starts there."""
    n = len(data) - GRAM + 1
    grams = np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()
    packed = mix(grams * np.uint64(0x9E3779B97F4A7C15))
    packed &= ~np.uint64((1 << PLACE) - 1)
    packed |= np.arange((1 << PLACE) - 1, (1 << PLACE) - 1 - n, -1, dtype=np.uint64)
    step = 1
    while 2 * step <= WINDOW:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    packed = np.minimum(packed[:len(packed) - (WINDOW - step)], packed[WINDOW - step:])
    return ((1 << PLACE) - 1) - (packed & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def find_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the buffer) of the anchors of all strings of LENGTH bytes inside the texts."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) > BLOCK + LENGTH and len(offsets) == 2:
        found = [find_anchors(part := data[a:a + BLOCK + LENGTH], np.array([0, len(part)]))[1] + a
                 for a in range(0, len(data), BLOCK)]
        places = np.unique(np.concatenate(found))
        return np.zeros(len(places), np.int64), places
    anchor = _least(data)
    size = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - offsets[:-1], size)
    anchor = anchor[start]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    return text[new], anchor[new]


def anchors(texts: DataFrame) -> DataFrame:
    """id, place, middle (hash), context (hash): every anchor of every different text of a batch.

    Copies inside a batch are skipped: what they add, that the text occurs more than once, is known from its count.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            fresh = np.zeros(len(ids), bool)
            fresh[np.unique(ids, return_index=True)[1]] = True
            for first, stop, data, offsets in text_slices(batch.column("text")):
                text, place = find_anchors(data, offsets)
                use = fresh[first:stop][text]
                text, place = text[use], place[use]
                roll = Rolling(data)
                low = np.maximum(place - SIDE, offsets[text])
                high = np.minimum(place + MIDDLE + SIDE, offsets[text + 1])
                shape = ((place - low) * 1024 + (high - place)).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:stop][text]), pa.array(place - offsets[text]),
                     pa.array(roll(place, place + MIDDLE).view(np.int64)),
                     pa.array(mix(roll(low, high) + shape).view(np.int64))],
                    names=["id", "place", "middle", "context"])

    return texts.select("id", "text").mapInArrow(scan, "id bigint, place bigint, middle bigint, context bigint")


def _contexts(texts: DataFrame) -> DataFrame:
    """middle, id, place, before, after, symbols of the anchors listed in ``wanted`` of each text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "wanted")), strict=True):
                raw = text.encode()
                for w in wanted:
                    a = w["place"]
                    before, after = raw[max(0, a - SIDE):a], raw[a + MIDDLE:a + MIDDLE + SIDE]
                    rows.append((w["middle"], name, a, before, after))
                if len(rows) >= 5000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return texts.mapInArrow(cut, "middle bigint, id bigint, place bigint, before binary, after binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["middle", "id", "place", "before", "after"])


def _side(column: pa.Array, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows x SIDE symbols, bytes present); absent ones are PAD, on the far side of the anchor."""
    parts = column.to_pylist()
    size = np.array([len(p) for p in parts], np.int64)
    grid = np.full((len(parts), SIDE), PAD, np.int16)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    grid[row, at if right else at + (SIDE - size[row])] = flat
    return grid, size


def repeated_starts(middle: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """rows x WINDOW: whether the string that starts d bytes before the anchor occurs at another row of the group."""
    n = len(middle)
    group = np.unique(middle, return_inverse=True)[1].astype(np.int32)

    def columns() -> Iterator[np.ndarray]:
        for k in range(SIDE - 1, -1, -1):
            yield after[:, k]
        yield group
        for k in range(SIDE - 1, -1, -1):
            yield before[:, k]

    marked = np.zeros((n, WINDOW), bool)
    for turn, (order, common) in enumerate(rounds(columns(), n, WINDOW)):
        if turn >= SIDE:
            at = np.flatnonzero(common >= WINDOW)
            marked[order[at], turn - SIDE] = True
            marked[order[at - 1], turn - SIDE] = True
    return marked


def _spans(batch: pa.RecordBatch) -> pa.RecordBatch:
    """id, start, stop of the bytes under repeated strings, for whole groups of contexts."""
    before, left = _side(batch.column("before"), right=False)
    after, right = _side(batch.column("after"), right=True)
    marked = repeated_starts(batch.column("middle").to_numpy(), before, after)
    # A string needs its bytes on both sides.
    d = np.arange(WINDOW)
    marked &= (d <= left[:, None]) & (SIDE - d <= right[:, None])
    edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    place = batch.column("place").to_numpy()[row]
    return pa.RecordBatch.from_arrays(
        [batch.column("id").take(pa.array(row)), pa.array(place - high), pa.array(place - low + LENGTH)],
        names=["id", "start", "stop"])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by middle: take whole groups until there are enough to be worth a run of columns."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        middle = batch.column("middle").to_numpy()
        cuts = np.flatnonzero(middle[1:] != middle[:-1]) + 1
        if held and middle[0] != held[-1].column("middle")[-1].as_py():
            cuts = np.append(0, cuts)
        start = 0
        for cut in cuts:
            if count + cut - start >= TOGETHER:
                done = pa.concat_batches([*held, batch.slice(start, cut - start)])
                if done.num_rows:
                    yield _spans(done)
                held, count, start = [], 0, int(cut)
        rest = batch.slice(start)
        if rest.num_rows:
            held.append(rest)
            count += rest.num_rows
    if held:
        yield _spans(pa.concat_batches(held))


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """middle, back, string (hash), id, place: every string of every context of a heavy group."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            out: list[tuple[np.ndarray, ...]] = []
            for middle, name, place, before, after in zip(*(part.column(c).to_pylist() for c in part.schema.names),
                                                          strict=True):
                raw = np.frombuffer(before + after, np.uint8)
                back = np.arange(max(0, SIDE - len(after)), len(before) + 1)
                value = Rolling(raw)(len(before) - back, len(before) + SIDE - back)
                out.append((np.full(len(back), middle), back, value.view(np.int64), np.full(len(back), name),
                            np.full(len(back), place)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                             names=["middle", "back", "string", "id", "place"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """id, start, stop: spans of bytes (overlapping or not) under repeated strings, of the different texts.

    texts: id (one per different text), doc_id, text. A stop of -1 stands for every string with the anchor at ``start``.
    """
    found = stored(anchors(texts), "anchors")
    shared = found.groupBy("middle").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")
                                         ).where("n > 1").select("middle", "n", F.expr("a = b").alias("alike"))
    shared = stored(shared, "shared")
    # Anchors of a middle with more than one of HOT_SHARE anchors stay where they are: at most so many middles are sent out.
    often = F.col("n") * HOT_SHARE > found.count()
    hot, rest = (shared.where(w).drop("n") for w in (often, ~often))
    members = stored(found.join(F.broadcast(hot.select("middle")), "middle", "left_anti").join(rest, "middle").unionByName(
        found.join(F.broadcast(hot), "middle")), "members")
    sure = members.where("alike").select("id", "place")
    mixed = members.where("not alike")
    forms = stored(mixed.groupBy("middle", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("one")), "forms")
    twice = mixed.join(forms.where("n > 1").select("middle", "context"), ["middle", "context"]).select("id", "place")
    # One row of each different context; the text of each is cut out of one document.
    wanted = forms.groupBy("one.id").agg(F.collect_list(F.struct("one.place", "middle")).alias("wanted"))
    holder = texts.select("id", "doc_id").groupBy("id").agg(F.min("doc_id").alias("doc_id")).join(wanted, "id")
    cut = stored(_contexts(texts.join(holder, ["id", "doc_id"]).select("id", "text", "wanted")), "contexts")
    heavy = cut.groupBy("middle").count().where(F.col("count") > HEAVY).select("middle")
    heavy = stored(heavy, "heavy")
    light = (
        cut.join(heavy, "middle", "left_anti").repartition("middle").sortWithinPartitions("middle")
        .mapInArrow(_ordered, "id bigint, start bigint, stop bigint")
    )
    spans = light.union(sure.union(twice).select("id", F.col("place").alias("start"), F.lit(-1).cast("bigint").alias("stop")))
    if not heavy.isEmpty():
        strings = cut.join(heavy, "middle", "left_semi").mapInArrow(
            _string_hashes, "middle bigint, back bigint, string bigint, id bigint, place bigint")
        again = strings.groupBy("middle", "back", "string").count().where("count > 1").drop("count")
        start = F.col("place") - F.col("back")
        spans = spans.union(strings.join(again, ["middle", "back", "string"]).select(
            "id", start.alias("start"), (start + LENGTH).alias("stop")))
    return spans


def _cut_text(raw: bytes, whole: bool, spans: list) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, bytes kept)."""
    if whole:
        return len(raw), 1, b""
    if not spans:
        return 0, 0, raw
    depth = np.zeros(len(raw) + 1, np.int32)
    for s in spans:
        start, stop = s["start"], s["stop"]
        if stop < 0:
            # Every string with this anchor: from the first that fits to the last.
            low = max(0, start - SIDE)
            high = min(start, len(raw) - LENGTH)
            start, stop = low, high + LENGTH
        depth[start] += 1
        depth[stop] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    data = np.frombuffer(raw, np.uint8)
    return int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), data[~gone].tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Texts are UTF-8 bytes, null counting as empty; strings never cross documents. A text that occurs twice is removed
    whole from LENGTH bytes on, so copies need no comparison. Shorter texts stay whole. Repeated rows are copies; a
    null doc_id is kept as any other. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("id", F.xxhash64("text")).withColumn("key", F.coalesce("doc_id", F.lit(-1).cast("bigint")))
    long = texts.where(F.octet_length("text") >= LENGTH)
    spans = repeated_spans(long.select("id", F.col("key").alias("doc_id"), "text"))
    # What to remove is joined to names first, so that copies of one text are split and move as names; texts move once,
    # each by its own name, and those too short for a repeat not at all.
    copies = stored(long.groupBy("id").count().where("count > 1").select("id"), "copies")
    names = long.select("key", "id").distinct()
    gone = salted_join(copies, names, ["id"], "key").select("key", "id", F.lit(True).alias("whole"))
    marks = spans.join(copies, "id", "left_anti").groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    notes = stored(gone.unionByName(names.join(marks, "id"), allowMissingColumns=True), "notes")
    short = texts.where(F.octet_length("text") < LENGTH).select("doc_id", "text")
    told = long.join(notes, ["key", "id"], "left").select("doc_id", "text", "whole", "spans").unionByName(
        short, allowMissingColumns=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, whole, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "whole", "spans")),
                                                strict=True):
                raw = text.encode()
                removed, runs, kept = _cut_text(raw, bool(whole) and len(raw) >= LENGTH, found or [])
                rows.append((name, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return told.mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
