"""Hard negatives by exact integer scores, worked out with the method of the Four Russians.

A vector's components are whole numbers. A candidate is kept as bit planes: one byte holds one bit of eight neighbouring
components. For each group of eight components an anchor has the 256 sums of all subsets of its own components, so one
look-up gives what a plane's byte adds; sums of a plane are shifted by the plane's place and added up (the top plane, the
sign, is taken away). Nothing is rounded.

Anchors are the query set. They go to the tasks in parts of bounded size, candidates stay where they are, and a task sends
on the best rows of each anchor only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

GROUP = 8
# Anchors that are sent out at once (4 MB at 64 components), and those whose tables are held side by side.
PART = 8192
SIDE_BY_SIDE = 64
# Rows of a candidate block.
BLOCK = 4096
POSITIVES, NEGATIVES = 5, 10
# Shares of the positive's score, in hundredths, that a negative's score lies between.
LOWEST, HIGHEST = 30, 90
# Scaled components are held within 2 ** 28, so that a score of 64 components cannot leave 64 bits.
MOST = 1 << 28


def whole_numbers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (floor(scale * x) of each component) of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(
        x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
                      ).where(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                                            F.col("label").cast("bigint").alias("label"), whole.alias("vector"))


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """planes x groups x rows: bytes of two's-complement bits, lowest plane first, the sign last."""
    n, width = vectors.shape
    groups = -(-width // GROUP)
    padded = np.zeros((n, groups * GROUP), np.int64)
    padded[:, :width] = vectors
    most = int(max(padded.max(initial=0), -1 - padded.min(initial=0)))
    planes = most.bit_length() + 1
    out = np.empty((planes, groups, n), np.uint8)
    for p in range(planes):
        bits = (padded >> p & 1).astype(np.uint8)
        out[p] = np.packbits(bits, axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: the sum of each subset of eight neighbouring components."""
    m, width = anchors.shape
    groups = -(-width // GROUP)
    padded = np.zeros((groups * GROUP, m), np.int64)
    padded[:width] = anchors.T
    parts = padded.reshape(groups, GROUP, m)
    out = np.zeros((groups, 1, m), np.int64)
    for k in range(GROUP):
        out = np.concatenate([out, out + parts[:, k:k + 1]], axis=1)
    # Narrow tables stay in the cache; a plane's sum is at most ``groups`` times as large.
    return out.astype(np.int32) if np.abs(out).max(initial=0) * max(groups, 1) < 1 << 31 else out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """anchors x rows: exact inner products."""
    total = np.zeros((planes.shape[2], tables.shape[2]), np.int64)
    for p in range(len(planes)):
        plane = np.zeros(total.shape, tables.dtype)
        # Groups that only one side has count as zero.
        for g in range(min(planes.shape[1], len(tables))):
            plane += tables[g].take(planes[p, g], axis=0)
        wide = plane.astype(np.int64) << p
        if p == len(planes) - 1:
            total -= wide
        else:
            total += wide
    return np.ascontiguousarray(total.T)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first ``k`` rows of each (anchor, slot); columns anchor, slot, id, score."""
    anchor, slot, name, score = found
    order = np.lexsort((name, -score, slot, anchor))
    anchor, slot = anchor[order], slot[order]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return [c[order[place < k]] for c in found]


def _merged(found: Iterator[list[np.ndarray]], k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Best rows of a task. What is held is cut whenever it has doubled, so it stays near anchors x slots x ``k``."""
    held = [np.zeros(0, np.int64) for _ in range(4)]
    limit = 1 << 18
    for more in found:
        held = [np.concatenate([a, b]) for a, b in zip(held, more, strict=True)]
        if len(held[0]) > limit:
            held = _best(held, k)
            limit = max(1 << 18, 2 * len(held[0]))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(held, k)], names=names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to blocks of about BLOCK rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _first_in_window(score: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(slot, position) of the first ``k`` rows with low <= score <= high of each slot; rows come sorted best first."""
    start = np.searchsorted(-score, -high, "left")
    stop = np.minimum(np.searchsorted(-score, -low, "right"), start + k)
    size = np.maximum(stop - start, 0)
    slot = np.repeat(np.arange(len(low)), size)
    return slot, np.arange(len(slot)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def best_positives(rows: DataFrame, anchors: dict[str, np.ndarray], k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: best rows of a task of the anchor's own label, but for itself."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value

        def found() -> Iterator[list[np.ndarray]]:
            for block in _blocks(batches):
                label, name = (block.column(c).to_numpy() for c in ("label", "vec_id"))
                vectors = _matrix(block.column("vector"))
                for own in np.intersect1d(label, anchors["label"]):
                    mine = np.flatnonzero(label == own)
                    mine = mine[np.argsort(name[mine], kind="stable")]
                    planes = bit_planes(vectors[mine])
                    those = np.flatnonzero(anchors["label"] == own)
                    for a in range(0, len(those), SIDE_BY_SIDE):
                        some = those[a:a + SIDE_BY_SIDE]
                        for who, line in zip(some, scores(planes, subset_sums(anchors["vector"][some])), strict=True):
                            top = np.argsort(-line, kind="stable")
                            top = top[name[mine[top[:len(top)]]] != anchors["vec_id"][who]][:k]
                            yield [np.full(len(top), anchors["vec_id"][who]), np.zeros(len(top), np.int64), name[mine[top]],
                                   line[top]]

        for batch in _merged(found(), k, ["anchor_id", "slot", "positive_id", "positive_score"]):
            yield batch.select(["anchor_id", "positive_id", "positive_score"])

    return rows.mapInArrow(scan, "anchor_id bigint, positive_id bigint, positive_score bigint")


def best_negatives(rows: DataFrame, anchors: dict[str, np.ndarray], k: int, lowest: int, highest: int) -> DataFrame:
    """anchor_id, slot, negative_id, negative_score: best rows of a task of other labels within each slot's bounds.

    anchors: also ``low`` and ``high`` (anchors x slots), the least and the greatest score of each slot."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value

        def found() -> Iterator[list[np.ndarray]]:
            for block in _blocks(batches):
                name = block.column("vec_id").to_numpy()
                order = np.argsort(name, kind="stable")
                name, label = name[order], block.column("label").to_numpy()[order]
                planes = bit_planes(_matrix(block.column("vector"))[order])
                for a in range(0, len(anchors["vec_id"]), SIDE_BY_SIDE):
                    some = slice(a, a + SIDE_BY_SIDE)
                    for i, line in enumerate(scores(planes, subset_sums(anchors["vector"][some])), a):
                        low, high = anchors["low"][i], anchors["high"][i]
                        # Only rows that some slot can take are put in order.
                        use = np.flatnonzero((label != anchors["label"][i]) & (line >= low.min()) & (line <= high.max()))
                        use = use[np.argsort(-line[use], kind="stable")]
                        slot, at = _first_in_window(line[use], name[use], low, high, k)
                        yield [np.full(len(slot), anchors["vec_id"][i]), slot, name[use[at]], line[use[at]]]

        yield from _merged(found(), k, ["anchor_id", "slot", "negative_id", "negative_score"])

    return rows.mapInArrow(scan, "anchor_id bigint, slot bigint, negative_id bigint, negative_score bigint")


def _top(rows: DataFrame, by: list[str], score: str, name: str, k: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), name)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _arrays(part: DataFrame) -> dict[str, np.ndarray]:
    """One part of the anchors: at most about PART rows."""
    arrow = part.select("vec_id", "label", "vector").toArrow().combine_chunks().sort_by("vec_id").combine_chunks()
    vectors = arrow["vector"].combine_chunks() if len(arrow) else pa.array([], pa.list_(pa.int32()))
    return {"vec_id": arrow["vec_id"].to_numpy(), "label": arrow["label"].to_numpy(), "vector": _matrix(vectors)}


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lowest: int = LOWEST, highest: int = HIGHEST, part: int = PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors: vec_id, label, vector (whole numbers). An anchor's positives are its best ``positives`` other rows
    (other vec_id) of its label; each one's negatives are the best rows of other labels whose score lies between ``lowest``
    and ``highest`` hundredths of the positive's. Best: higher score, then smaller id. Every anchor meets every row.

    Vectors of unequal length: a missing component counts as zero. A row that occurs again is a candidate again; an
    anchor that occurs again counts once, with its least label and vector. A positive that occurs again is answered once.
    An empty table gives no rows.
    """
    spark = rows.sparkSession
    anchors = stored(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("one")).select(
        "vec_id", "one.label", "one.vector"), "anchors")
    parts = max(-(-anchors.count() // part), 1)
    # Different ids are dealt by hash, so a part is ``part`` rows but for chance.
    own = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    kept: DataFrame | None = None
    for number in range(parts):
        some = _arrays(anchors.where(own == number))
        if not len(some["vec_id"]):
            continue
        near = stored(_top(best_positives(rows, some, positives), ["anchor_id"], "positive_score", "positive_id", positives,
                           "slot").dropDuplicates(["anchor_id", "positive_id"]), "positives")
        given = near.toArrow()  # at most ``positives`` rows an anchor of this part
        # An absent slot has bounds that no score meets.
        low = np.full((len(some["vec_id"]), positives), np.iinfo(np.int64).max)
        high = np.full_like(low, np.iinfo(np.int64).min)
        at = np.searchsorted(some["vec_id"], given["anchor_id"].to_numpy()), given["slot"].to_numpy() - 1
        score = given["positive_score"].to_numpy()
        low[at] = [-(-lowest * int(s) // 100) for s in score]
        high[at] = [highest * int(s) // 100 for s in score]
        some |= {"low": low, "high": high}
        found = _top(best_negatives(rows, some, negatives, lowest, highest).withColumn("slot", (F.col("slot") + 1).cast("int")),
                     ["anchor_id", "slot"], "negative_score", "negative_id", negatives, "rank")
        # Both sides hold a few rows an anchor of one part.
        found = stored(found.join(F.broadcast(near), ["anchor_id", "slot"]), "negatives")
        kept = found if kept is None else kept.union(found)
    if kept is None:
        kept = spark.createDataFrame([], "anchor_id bigint, slot int, negative_id bigint, negative_score bigint, rank int, "
                                         "positive_id bigint, positive_score bigint")
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100, over all rows.

    Rows with a null id, label or vector or any null or non-finite component take no part. Where vec_id is divisible by 7
    the label becomes (label + 1) % 10. Components are floor(256 * x), held within 2 ** 28. Other columns are not read.
    """
    rows = whole_numbers(embeddings.select("vec_id", "label", "embedding"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = stored(rows, "vectors")
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLE_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10"""
