"""Exact dense scoring, block against block, keeping only each block's best rows.

The comparison of queries with chunks is a matrix product, which the JVM would do one boxed number
at a time. Spark decides what meets what; a task multiplies one bounded block and returns at most
``k`` rows per query, so pairs are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import cut_lineage
from ..plans.skew import fits

CHUNK_BLOCK = 8192
QUERY_BLOCK = 512
VECTOR_BLOCK = 65536
SMALL_BLOCK = 512
DIGITS = 6


def _schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("container", chunks.schema["container"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("vector", T.DoubleType()),
        T.StructField("bm25", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ])


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, row starts and row lengths of a list column; a null row has length 0."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], column.type)
    sizes = np.asarray(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    values = np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return values, np.cumsum(sizes) - sizes, sizes


def _unit_rows(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of exactly ``width`` values scaled to length 1 (zero rows stay zero), and their places."""
    values, starts, sizes = _flat(column)
    rows = np.flatnonzero(sizes == width)
    block = values[starts[rows][:, None] + np.arange(width)[None, :]] if len(rows) else np.zeros((0, width))
    norm = np.sqrt((block * block).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm[:, None] > 0, block / norm[:, None], 0.0), rows


def cosine_block(chunk_vectors, query_vectors) -> np.ndarray:
    """Cosine of every chunk (rows) with every query (columns); unequal lengths score 0."""
    out = np.zeros((len(chunk_vectors), len(query_vectors)))
    for width in np.unique(_flat(query_vectors)[2]):
        if width == 0:
            continue
        q, q_rows = _unit_rows(query_vectors, int(width))
        c, c_rows = _unit_rows(chunk_vectors, int(width))
        if len(c_rows):
            out[np.ix_(c_rows, q_rows)] = c @ q.T
    return out


def best_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) places of the ``k`` best rows of each column; ties go to the earlier row."""
    n, m = score.shape
    if n > k:
        key = np.rint(score * 10**DIGITS).astype(np.int64) * n + (n - 1 - np.arange(n))[:, None]
        rows = np.argpartition(key, n - k, axis=0)[n - k:]
    else:
        rows = np.broadcast_to(np.arange(n)[:, None], (n, m))
    return rows.ravel(), np.broadcast_to(np.arange(m)[None, :], rows.shape).ravel()


def _kept(score: np.ndarray, floor: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``score`` that can still be among the ``k`` best of their column.

    ``floor`` is the k-th best score found before (rounded, as ``score`` is not yet): lower ones are out. Where many
    reach it, the block's own ``k`` best, of which no more can be kept, take their place.
    """
    if floor is not None:
        rows, cols = np.nonzero(score >= floor - 10.0**-DIGITS)
        if len(rows) <= 4 * k * score.shape[1]:
            return rows, cols
    return best_rows(np.round(score, DIGITS), k)


def _top(chunk_ids: pa.Array, chunk_vectors, query_ids: pa.Array, query_vectors, container,
         k: int, w_vec: float, w_kw: float, pairs=None, schema: pa.Schema | None = None,
         found: pa.Table | None = None) -> pa.Table:
    """Best ``k`` rows of each query in these chunks and in ``found``, the best rows of other chunks.

    Slice against slice, so memory does not grow with the number of either.
    """
    order = pc.array_sort_indices(chunk_ids)
    chunk_ids, chunk_vectors = chunk_ids.take(order), chunk_vectors.take(order)
    n, m = len(chunk_ids), len(query_ids)
    best = [] if found is None else [found]
    if pairs is not None and len(pairs[2]):
        at = pc.index_in(pairs[1], chunk_ids).to_numpy(zero_copy_only=False).astype(np.int64)
        of = pc.index_in(pairs[0], query_ids).to_numpy(zero_copy_only=False).astype(np.int64)
        by_row = np.argsort(at, kind="stable")
        at, of, weight = at[by_row], of[by_row], np.asarray(pairs[2])[by_row]
    else:
        at = None
    floor = _floor(best[0], query_ids, k) if best else None
    for lo in range(0, n, CHUNK_BLOCK):
        hi = min(lo + CHUNK_BLOCK, n)
        vector = cosine_block(chunk_vectors[lo:hi], query_vectors)
        keyword = np.zeros_like(vector) if at is not None else None
        score = w_vec * vector
        if at is not None:
            some = slice(*np.searchsorted(at, [lo, hi]))
            keyword[at[some] - lo, of[some]] = weight[some]
            score += w_kw * keyword
        rows, cols = _kept(score, floor, k)
        if not len(rows):
            continue
        best.append(pa.table(
            [query_ids.take(pa.array(cols)), pa.array([container] * len(rows), schema.field(1).type),
             chunk_ids.take(pa.array(rows + lo)), pa.array(vector[rows, cols]),
             pa.array(keyword[rows, cols] if keyword is not None else np.zeros(len(rows))),
             pa.array(np.round(score[rows, cols], DIGITS))],
            schema=schema,
        ))
        if len(best) > 1:
            best = [_first(pa.concat_tables(best), query_ids, k)]
        floor = _floor(best[0], query_ids, k)
    return best[0] if best else schema.empty_table()


def _first(rows: pa.Table, query_ids: pa.Array, k: int) -> pa.Table:
    """First ``k`` rows of each query by score, ties by chunk id."""
    of = pc.index_in(rows.column("query_id"), query_ids)
    places = pa.table([of, pc.negate(rows.column("score")), rows.column("chunk_id")], names=["q", "s", "c"])
    order = pc.sort_indices(places, sort_keys=[("q", "ascending"), ("s", "ascending"), ("c", "ascending")])
    q = of.take(order).to_numpy(zero_copy_only=False) if isinstance(of, pa.Array) else of.take(order).to_numpy()
    starts = np.searchsorted(q, q, side="left")
    return rows.take(order.filter(pa.array(np.arange(len(q)) - starts < k))).combine_chunks()


def _floor(rows: pa.Table, query_ids: pa.Array, k: int) -> np.ndarray:
    """Score of each query's k-th row; no bound for a query with fewer."""
    of = pc.index_in(rows.column("query_id"), query_ids).to_numpy().astype(np.int64)
    least = np.full(len(query_ids), np.inf)
    np.minimum.at(least, of, rows.column("score").to_numpy())
    return np.where(np.bincount(of, minlength=len(query_ids)) >= k, least, -np.inf)


def _by_slice(chunk_ids: pa.Array, chunk_vectors, query_ids: pa.Array, query_vectors, container, k: int, w_vec: float,
              w_kw: float, pairs=None, schema: pa.Schema | None = None) -> Iterator[pa.Table]:
    """``_top`` for one slice of the queries after the other."""
    of = None
    if pairs is not None and len(pairs[2]):
        of = pc.index_in(pairs[0], query_ids).to_numpy(zero_copy_only=False).astype(np.int64) // QUERY_BLOCK
    for lo in range(0, len(query_ids), QUERY_BLOCK):
        mine = None
        if of is not None:
            rows = pa.array(np.flatnonzero(of == lo // QUERY_BLOCK))
            mine = (pairs[0].take(rows), pairs[1].take(rows), np.asarray(pairs[2])[rows.to_numpy()])
        yield _top(chunk_ids, chunk_vectors, query_ids[lo:lo + QUERY_BLOCK], query_vectors[lo:lo + QUERY_BLOCK],
                   container, k, w_vec, w_kw, mine, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def streamed_top_k(queries: DataFrame, chunks: DataFrame, k: int, w_vec: float,
                   limit_bytes: int) -> DataFrame | None:
    """Best rows of each task's chunks, with the query vectors held by every task.

    A task holds the best ``k`` rows of the queries so far, and compares one slice of them with one batch at a time.
    Returns None when the query vectors exceed ``limit_bytes``; the fetch that finds out is itself
    bounded by that size.
    """
    wanted = queries.select("query_id", "container", "embedding")
    widest = wanted.agg(F.max(F.size("embedding")), F.count("*")).first()
    width, count = widest[0] or 0, widest[1]
    # The best rows of a query take up to six values of eight bytes each.
    if count * max(width, 1, 6 * k) * 8 > limit_bytes:
        return None
    held = wanted.toArrow()
    schema = _schema(queries, chunks)
    out = _arrow_schema(schema)
    shared = queries.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.combine_chunks()
        names, slices, best = table.column("container"), {}, {}
        for batch in batches:
            tags = batch.column("container")
            for name in tags.unique().to_pylist():
                if name not in slices:
                    mine = table.filter(pc.equal(names, name)).combine_chunks()
                    slices[name] = [mine.slice(lo, QUERY_BLOCK) for lo in range(0, mine.num_rows, QUERY_BLOCK)]
                part = batch.filter(pc.equal(tags, name))
                for number, mine in enumerate(slices[name]):
                    best[name, number] = _top(
                        part.column("chunk_id"), part.column("embedding"),
                        _one(mine.column("query_id")), _one(mine.column("embedding")),
                        name, k, w_vec, 0.0, schema=out, found=best.get((name, number)),
                    )
        for found in best.values():
            yield from found.to_batches()

    cores = queries.sparkSession.sparkContext.defaultParallelism
    rows = chunks.select("container", "chunk_id", "embedding")
    if len(rows.inputFiles()) < cores:
        rows = rows.repartition(cores, "container", "chunk_id")
    return rows.mapInArrow(scan, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def block_top_k(queries: DataFrame, chunks: DataFrame, pairs: DataFrame | None, k: int,
                w_vec: float, w_kw: float, chunk_block: int | None = None,
                query_block: int | None = None) -> DataFrame:
    """Best ``k`` rows of every (chunk block, query block) of a container.

    Blocks come from hashes and container sizes, so a container with most of the chunks is spread
    over as many tasks as its size asks for. A row is copied to every block of the other side, so blocks without
    ``pairs`` are large and a task works through them in slices. ``pairs`` adds sparse BM25 values
    ``(query_id, container, chunk_id, bm25)``; all others count as 0.
    """
    chunk_block = chunk_block or (VECTOR_BLOCK if pairs is None else CHUNK_BLOCK)
    query_block = query_block or (VECTOR_BLOCK if pairs is None else QUERY_BLOCK)
    # Fresh column ids: both sides may come from one table.
    chunks = chunks.select(*[F.col(c).alias(c) for c in ("container", "chunk_id", "embedding")])
    queries = queries.select(*[F.col(c).alias(c) for c in ("container", "query_id", "embedding")])
    cores = queries.sparkSession.sparkContext.defaultParallelism
    sizes = (
        chunks.groupBy("container").agg(F.count("*").alias("_n"))
        .join(queries.groupBy("container").agg(F.count("*").alias("_m")), "container")
        .select("container",
                # Small containers are still cut finely enough to use every core.
                F.greatest(F.ceil(F.col("_n") / chunk_block), F.least(F.lit(cores), F.ceil(F.col("_n") / SMALL_BLOCK)))
                .cast("int").alias("_cn"),
                F.ceil(F.col("_m") / query_block).cast("int").alias("_qn"))
    )
    # One row a container, counted once. Rows that look their container up stay where they are: dealt by it, a container
    # with most of them would end in one task.
    sizes = cut_lineage(sizes)
    sizes = F.broadcast(sizes) if fits(sizes) else sizes

    def spread(column: str, parts: str):
        return F.pmod(F.xxhash64(column), F.col(parts)).cast("int")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    left = (
        chunks.select("container", "chunk_id", "embedding").join(sizes, "container")
        .select("container", spread("chunk_id", "_cn").alias("_cb"), every("_qn").alias("_qb"),
                "chunk_id", "embedding")
    )
    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    right = (
        queries.select("query_id", "container", "embedding").join(sizes, "container")
        .select("container", every("_cn").alias("_cb"), spread("query_id", "_qn").alias("_qb"),
                "query_id", "embedding", F.lit(None).cast(f"array<{id_type}>").alias("ids"),
                F.lit(None).cast("array<double>").alias("bm25"))
    )
    if pairs is not None:
        # One row per query and block, which cannot hold more entries than the block has chunks.
        packed = (
            pairs.join(sizes, "container")
            .select("container", spread("chunk_id", "_cn").alias("_cb"), spread("query_id", "_qn").alias("_qb"),
                    "query_id", F.struct("chunk_id", "bm25").alias("_p"))
            .groupBy("container", "_cb", "_qb", "query_id").agg(F.collect_list("_p").alias("_p"))
        )
        right = right.unionByName(packed.select(
            "container", "_cb", "_qb", "query_id", F.lit(None).cast(queries.schema["embedding"].dataType).alias("embedding"),
            F.col("_p.chunk_id").alias("ids"), F.col("_p.bm25").alias("bm25")))
    schema = _schema(queries, chunks)
    out = _arrow_schema(schema)

    def score(key, c: pa.Table, q: pa.Table) -> pa.Table:
        if c.num_rows == 0 or q.num_rows == 0:
            return out.empty_table()
        is_query = pc.is_null(q.column("bm25"))
        heads = q.filter(is_query)
        tail = q.filter(pc.invert(is_query))
        ids = _one(tail.column("ids"))
        owner = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy(zero_copy_only=False))
        sparse = (_one(tail.column("query_id")).take(pa.array(owner)), ids.flatten(),
                  _one(tail.column("bm25")).flatten().to_numpy(zero_copy_only=False))
        return pa.concat_tables(_by_slice(
            _one(c.column("chunk_id")), _one(c.column("embedding")), _one(heads.column("query_id")),
            _one(heads.column("embedding")), key[0].as_py(), k, w_vec, w_kw, sparse, out,
        ))

    keys = ["container", "_cb", "_qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)
