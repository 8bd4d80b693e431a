"""BM25 of a query batch over blocks of chunks: exact, with block maxima, and without a shuffle of postings.

A batch's terms are numbered and sent out; one pass over the index keeps of each chunk the numbers and counts of the terms
the batch asks for (``asked_terms``). From these narrow stored rows come the document frequencies, and the scores:

- Rows of a task are put in blocks of one container and similar lengths. In a block each term has its greatest gain.
- A query's threshold is the k-th best score that the task has seen for it. A block where the greatest gains of all its
  terms together stay under the threshold is skipped.
- Else the terms are put in order of their greatest gains. Those that together stay under the threshold cannot lift a chunk
  over it alone: only the other, essential terms propose chunks, and only chunks that the rest could still lift are looked
  up for the rest.

No chunk among the first k is lost: the bounds are upper ones, and the threshold leaves room for the rounding. A task sends
on its rows over the threshold, so the shuffle holds about k rows a query and task. Batches of more terms than may be
sent out are worked on in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.batches import gathered, small_batches, steps
from ..plans.scratch import cut_lineage
from .index import Index

# Chunks of a block, at most.
BLOCK = 1024
# Query terms of a part, about.
PART_TERMS = 500_000
# Terms that are looked up, and scores that are sent on, at a time: what a worker holds, whatever the batch.
STEP = 200_000
# Rows and bytes of chunks that are put in blocks together.
GATHER_ROWS, GATHER_BYTES = 10_000, 16 << 20
# Scores are rounded to six digits before they are ranked.
SLACK = 2e-6


@dataclass(frozen=True)
class Batch:
    """Numbered terms and queries of one part. ``terms``, ``weights`` lie query by query, cut at ``edges``."""

    query_id: pa.Array
    container: list[str]
    edges: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    avgdl: dict[str, float]
    k1: float
    b: float


def _chunks_terms(index: Index) -> DataFrame:
    """(container, chunk_id, dl, names, uses): one row a chunk."""
    if index.forward is not None:
        return index.forward.select("container", "chunk_id", "dl", F.col("terms.term").alias("names"),
                                    F.col("terms.tf").alias("uses"))
    return index.postings.groupBy("container", "chunk_id").agg(
        F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("_t")).select(
        "container", "chunk_id", "dl", F.col("_t.term").alias("names"), F.col("_t.tf").alias("uses"))


def _joined(container: pa.Array, term: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(container.cast(pa.large_string()), term.cast(pa.large_string()),
                                       pa.scalar("\x00", pa.large_string()))


def _keep(shared, columns: list[str]):
    """Of each row the places and counts of the asked terms; about ``STEP`` terms are looked up at a time."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, stop - start) for b in batches for start, stop in steps(
                pc.fill_null(pc.list_value_length(b.column("names")), 0).to_numpy().astype(np.int64), STEP)):
            names, uses = batch.column("names"), batch.column("uses")
            empty = pa.array([], names.type.value_type)
            sizes = pc.fill_null(pc.list_value_length(names), 0).to_numpy().astype(np.int64)
            own = np.repeat(np.arange(batch.num_rows), sizes)
            flat = names.flatten() if len(own) else empty
            at = pc.index_in(_joined(batch.column("container").take(pa.array(own)), flat), shared.value)
            known = ~pc.is_null(at).to_numpy(zero_copy_only=False)
            edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own[known], minlength=batch.num_rows))]).astype(np.int32))
            mask = pa.array(known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("container"), batch.column("chunk_id"), pc.fill_null(batch.column("dl").cast(pa.int64()), 0),
                 pa.ListArray.from_arrays(edges, at.filter(mask).cast(pa.int32())),
                 pa.ListArray.from_arrays(edges, (uses.flatten() if len(own) else pa.array([], pa.int64())).cast(pa.int64()).filter(mask))],
                names=columns)

    return keep


def asked_terms(index: Index, container: pa.Array, term: pa.Array) -> DataFrame:
    """(container, chunk_id, dl, terms, uses) of every chunk: places of its terms in the given list, and their counts."""
    if index.forward is None:
        wanted = index.postings.sparkSession.createDataFrame(pa.table({"container": container, "term": term}))
        postings = index.postings.join(F.broadcast(wanted), ["container", "term"], "left_semi")
        index = Index(index.chunks, postings, index.stats)
    rows = _chunks_terms(index)
    shared = rows.sparkSession.sparkContext.broadcast(_joined(container, term))
    schema = T.StructType([rows.schema["container"], rows.schema["chunk_id"], T.StructField("dl", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("uses", T.ArrayType(T.LongType()))])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(_keep(shared, schema.names), schema)


def gains(uses: np.ndarray, dl: np.ndarray, avgdl: float, k1: float, b: float) -> np.ndarray:
    """What the uses of a term add in a chunk of ``dl`` tokens, before the term's weight."""
    return uses * (k1 + 1) / (uses + k1 * (1 - b + b * (dl / avgdl)))


class Block:
    """Postings of some chunks of one container, term by term, with the greatest gain of each term."""

    def __init__(self, rows: pa.RecordBatch, batch: Batch) -> None:
        sizes = np.diff(rows.column("terms").offsets.to_numpy())
        term = rows.column("terms").flatten().to_numpy()
        uses = rows.column("uses").flatten().to_numpy().astype(float)
        place = np.repeat(np.arange(rows.num_rows), sizes)
        dl = rows.column("dl").to_numpy().astype(float)[place]
        order = np.argsort(term, kind="stable")
        self.n = rows.num_rows
        self.place = place[order]
        self.gain = gains(uses[order], dl[order], batch.avgdl[rows.column("container")[0].as_py()], batch.k1, batch.b)
        self.names, self.start = np.unique(term[order], return_index=True)
        self.stop = np.append(self.start[1:], len(term))
        self.most = np.maximum.reduceat(self.gain, self.start) if len(term) else np.zeros(0)

    def scores(self, terms: np.ndarray, weights: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(place, score) of the chunks that reach ``least``, and how many were scored."""
        at = np.minimum(np.searchsorted(self.names, terms), max(len(self.names) - 1, 0))
        held = np.flatnonzero(self.names[at] == terms) if len(self.names) else np.zeros(0, np.int64)
        bound = weights[held] * self.most[at[held]]
        order = np.argsort(bound)
        upto = np.cumsum(bound[order])
        if not len(held) or upto[-1] < least:
            return np.zeros(0, np.int64), np.zeros(0), 0
        cut = int(np.searchsorted(upto, least, "left"))
        rest = upto[cut - 1] if cut else 0.0
        total = np.zeros(self.n)
        seen = np.zeros(self.n, bool)
        for k in held[order[cut:]]:
            own = slice(self.start[at[k]], self.stop[at[k]])
            total[self.place[own]] += weights[k] * self.gain[own]
            seen[self.place[own]] = True
        found = np.flatnonzero(seen)
        found = found[total[found] + rest >= least]
        for k in held[order[:cut]]:
            own = self.place[self.start[at[k]]:self.stop[at[k]]]
            spot = np.minimum(np.searchsorted(own, found), len(own) - 1)
            hit = own[spot] == found
            total[found[hit]] += weights[k] * self.gain[self.start[at[k]] + spot[hit]]
        reached = found[total[found] >= least]
        return reached, total[reached], len(found)


def _blocks(table: pa.Table, containers: set[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one container and of similar lengths, in order of their ids; other containers are left out."""
    order = table.filter(pc.is_in(table.column("container"), pa.array(sorted(containers), pa.string()))).sort_by([("container", "ascending"), ("dl", "ascending")])
    names = order.column("container").to_pylist()
    start = 0
    for stop in range(1, len(names) + 1):
        if stop == len(names) or names[stop] != names[start] or stop - start == BLOCK:
            yield order.slice(start, stop - start).sort_by("chunk_id").combine_chunks().to_batches()[0]
            start = stop


def _score(shared, k: int | None):
    """Scores of all blocks of a task; with ``k`` only rows that may be among a query's first ``k``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch: Batch = shared.value
        least = np.full(len(batch.container), -np.inf)
        best: list[np.ndarray] = [np.zeros(0)] * len(batch.container)
        asking: dict[str, list[int]] = {}
        for q, name in enumerate(batch.container):
            asking.setdefault(name, []).append(q)

        def told(part: pa.RecordBatch, who: list, where: list, score: list) -> pa.RecordBatch:
            who, where = pa.array(np.concatenate(who)), pa.array(np.concatenate(where))
            return pa.RecordBatch.from_arrays(
                [batch.query_id.take(who), part.column("container").take(pa.array(np.zeros(len(who), np.int64))),
                 part.column("chunk_id").take(where), pa.array(np.concatenate(score))],
                names=["query_id", "container", "chunk_id", "bm25_raw"])

        for rows in gathered(batches, GATHER_ROWS, GATHER_BYTES):
            for part in _blocks(rows, asking.keys()):
                block = Block(part, batch)
                who, where, score, held = [], [], [], 0
                for q in asking[part.column("container")[0].as_py()]:
                    own = slice(batch.edges[q], batch.edges[q + 1])
                    place, value, _ = block.scores(batch.terms[own], batch.weights[own], least[q])
                    if k is not None and len(value):
                        if len(value) > k:
                            # Rows are in order of their ids, so the first of equal ones stay.
                            top = np.sort(np.argsort(-np.round(value, 6), kind="stable")[:k])
                            place, value = place[top], value[top]
                        best[q] = np.sort(np.concatenate([best[q], value]))[-k:]
                        if len(best[q]) == k:
                            least[q] = best[q][0] - SLACK
                    who.append(np.full(len(place), q))
                    where.append(place)
                    score.append(value)
                    held += len(place)
                    if held >= STEP:
                        yield told(part, who, where, score)
                        who, where, score, held = [], [], [], 0
                if who:
                    yield told(part, who, where, score)

    return run


def _part(terms: DataFrame, index: Index, k: int | None, k1: float, b: float) -> DataFrame:
    """Scores of the queries of one part, whose terms may be sent out."""
    # One row a query, whatever the type of its id.
    asked = terms.groupBy("query_id", "container").agg(F.collect_list(F.struct("term", "qtf")).alias("asked")).toArrow(
        ).combine_chunks()
    lists = asked["asked"].combine_chunks() if len(asked) else pa.array([], pa.list_(pa.struct({"term": pa.string(), "qtf": pa.int64()})))
    sizes = np.diff(lists.offsets.to_numpy()) if len(asked) else np.zeros(0, np.int64)
    flat = lists.flatten()
    boxes = asked["container"].combine_chunks() if len(asked) else pa.array([], pa.string())
    of_term = boxes.take(pa.array(np.repeat(np.arange(len(asked)), sizes)))
    names = pa.table({"container": of_term, "term": flat.field("term")}).group_by(["container", "term"]).aggregate([]).combine_chunks()
    container, term = (names[c].combine_chunks().cast(pa.string()) if len(names) else pa.array([], pa.string())
                       for c in ("container", "term"))
    # Every chunk's few asked terms, read for the counts and for the scores.
    rows = cut_lineage(asked_terms(index, container, term))
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(term))
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    stats = rows.groupBy("container").agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    if index.forward is None:
        stats = index.stats.select("container", "n_docs", "avgdl")
    own = rows.sparkSession.createDataFrame(pa.table({"container": container.unique()}))
    size = {r["container"]: (r["n_docs"], r["avgdl"]) for r in stats.join(F.broadcast(own), "container", "left_semi").collect()}
    at = pc.index_in(_joined(of_term, flat.field("term")), _joined(container, term)).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.array([size.get(c, (0, 0))[0] for c in of_term.to_pylist()], float)
    weight = flat.field("qtf").to_numpy() * np.log((total - df[at] + 0.5) / (df[at] + 0.5) + 1)
    use = df[at] > 0
    edges = np.concatenate([[0], np.cumsum(use)])[np.concatenate([[0], np.cumsum(sizes)])]
    batch = Batch(asked["query_id"].combine_chunks() if len(asked) else pa.array([]), boxes.to_pylist(), edges,
                  at[use].astype(np.int32), weight[use], {c: float(mean or 1.0) for c, (_, mean) in size.items()}, k1, b)
    batch = _by_place(batch)
    schema = T.StructType([terms.schema["query_id"], rows.schema["container"], rows.schema["chunk_id"],
                           T.StructField("bm25_raw", T.DoubleType())])
    return rows.mapInArrow(_score(rows.sparkSession.sparkContext.broadcast(batch), k), schema)


def _by_place(batch: Batch) -> Batch:
    """Terms of each query in order of their places; queries whose container has no chunks ask nothing."""
    query = np.repeat(np.arange(len(batch.container)), np.diff(batch.edges))
    order = np.lexsort((batch.terms, query))
    return Batch(batch.query_id, batch.container, batch.edges, batch.terms[order], batch.weights[order], batch.avgdl,
                 batch.k1, batch.b)


def bm25_scores(terms: DataFrame, index: Index, k1: float, b: float, k: int | None = None,
                part_terms: int | None = None) -> DataFrame:
    """``(query_id, container, chunk_id, bm25_raw)`` of every chunk that shares a term with a query, or with ``k`` of
    those only that may be among the query's first ``k``.

    terms: (query_id, container, term, qtf), a query's terms once each. Chunks and queries without container meet nothing;
    a batch without terms gives no rows.
    """
    terms = cut_lineage(terms.where("container IS NOT NULL AND query_id IS NOT NULL"))
    parts = max(1, -(-terms.count() // (part_terms or PART_TERMS)))
    if parts == 1:
        return _part(terms, index, k, k1, b)
    own = F.pmod(F.xxhash64("query_id", "container"), F.lit(parts))
    return reduce(DataFrame.unionByName, (_part(terms.where(own == p), index, k, k1, b) for p in range(parts)))
