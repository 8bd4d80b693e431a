"""SimHash near duplicates: fingerprints at few differing bits, sifted by a table of distances to reference fingerprints.

Candidates. Two of the four 16-bit blocks of a fingerprint stay the same under two differing bits, so every link meets in
one of the six tables keyed by a pair of blocks. A bucket with too many fingerprints is keyed by a third of its free bits
more, in three tables, one of which again holds both ends of every link; a bucket of twelve free bits cannot be too large.

Sift. In a bucket each fingerprint has its row of Hamming distances to the references. By the triangle inequality no
coordinate of a link differs by more than the limit, so the rows are swept in the order of the first coordinate and pairs
drop out at the first coordinate that differs more. The exclusive or of the survivors decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import salted_join
from .components import components
from .kernels import mix
from .tables import join_names, stored

WIDTH = 3
SEED = 42
BITS = 64
BLOCKS = 4
LIMIT = 2
REFERENCES = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# Different fingerprints that are compared in one bucket; larger buckets get a longer key.
TOGETHER = 4096
# Hashes whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit by bit the majority of the XXH64 of all shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(len(words) - width + 1, 1)
    first, last = starts[:n], ends[-n:]
    count = np.zeros(BITS, np.int64)
    for a in range(0, n, CHUNK):
        part = zip(first[a:a + CHUNK].tolist(), last[a:a + CHUNK].tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in part), "<u8", min(CHUNK, n - a))
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, node (the fingerprint as a signed number) of every row, in one pass."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value.view(np.int64))],
                                             names=["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id bigint, node bigint")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def first_masks(limit: int = LIMIT, blocks: int = BLOCKS) -> list[int]:
    """Bits kept by each table: all choices of blocks that ``limit`` differing bits must leave untouched."""
    size = BITS // blocks
    block = [((1 << size) - 1) << (k * size) for k in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - limit)]


def longer_masks(mask: int, limit: int = LIMIT) -> list[int]:
    """``mask`` and one of ``limit`` + 1 even shares of the bits it leaves free."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    return [mask | sum(1 << int(k) for k in share) for share in np.array_split(free, limit + 1)]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each pair (a, b); afterwards every entry of ``root`` names its root."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root[:] = up


def bucket_links(bucket: np.ndarray, value: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links between values of the same bucket that join what other links of the bucket have not; rows by bucket."""
    table = np.bitwise_count(value[:, None] ^ REFERENCES)
    order = np.lexsort((table[:, 0], bucket))
    bucket, value, table = bucket[order], value[order], table[order].astype(np.int8)
    end = np.searchsorted(bucket, bucket, "right")
    root = np.arange(len(value))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    alive, step = np.arange(len(value)), 0
    while len(alive):
        step += 1
        alive = alive[alive + step < end[alive]]
        alive = alive[table[alive + step, 0] - table[alive, 0] <= limit]
        low = alive[root[alive] != root[alive + step]]
        for k in range(1, table.shape[1]):
            if not len(low):
                break
            low = low[np.abs(table[low + step, k] - table[low, k]) <= limit]
        low = low[np.bitwise_count(value[low] ^ value[low + step]) <= limit]
        if len(low):
            found.append((value[low], value[low + step]))
            _unite(root, low, low + step)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one that may go on in the next batch waits for it."""
        held = [np.zeros(0, np.int64)] * 3

        def links(mask: np.ndarray, key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(mask), bool)
            new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
            u, v = bucket_links(np.cumsum(new), node.view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("mask", "key", "node"), strict=True)]
            mask, key, _ = held
            open_ = int(np.argmax((mask == mask[-1]) & (key == key[-1])))
            if open_:
                yield links(*(h[:open_] for h in held))
                held = [h[open_:] for h in held]
        if len(held[0]):
            yield links(*held)

    return run


def links(nodes: DataFrame, limit: int = LIMIT, together: int = TOGETHER) -> DataFrame:
    """(u, v): enough of the pairs of different ``nodes`` at ``limit`` or fewer differing bits to connect all of them."""
    masks = first_masks(limit)
    rows = nodes.select(F.explode(F.lit([_signed(m) for m in masks])).alias("mask"), "node")
    found = None
    while True:
        rows = rows.withColumn("key", F.col("node").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
        members = stored(salted_join(sizes, rows, ["mask", "key"], "node").select("mask", "key", "node", "size"), "members")
        # Buckets of at most twelve free bits hold 4,096 fingerprints at most.
        large = (F.col("size") > together) & (F.bit_count("mask") < BITS - 12)
        met = members.where(~large).repartition("mask", "key").sortWithinPartitions("mask", "key")
        part = stored(met.select("mask", "key", "node").mapInArrow(_compare(limit), "u bigint, v bigint"), "links")
        found = part if found is None else found.union(part)
        heavy = members.where(large)
        if heavy.isEmpty():
            return found
        # A third of the free bits more, so three rounds at most.
        longer = F.create_map(*(F.lit(x) for m in masks for x in (_signed(m), [_signed(k) for k in longer_masks(m, limit)])))
        rows = heavy.select(F.explode(longer[F.col("mask")]).alias("mask"), "node").distinct()
        masks = sorted({k for m in masks for k in longer_masks(m, limit)})


def near_duplicates(docs: DataFrame, width: int = WIDTH, limit: int = LIMIT, together: int = TOGETHER) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id it reaches).

    Texts are read whole, A-Z lower-cased; words are runs without ASCII white space; a text of fewer words than ``width``
    is one shingle. Null, empty and blank texts have fingerprint zero and are linked like any other. Copies, repeated rows
    and other texts of one fingerprint are one node from the start and are never paired. Rows without doc_id take part
    and get the least doc_id of their component, null if it has none. Ties cannot occur: ids decide. An empty table gives
    no rows; other columns, whatever their names, are not read.
    """
    base = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(base.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    home = stored(components(links(nodes.select("node"), limit, together)), "home")
    linked = join_names(home, home.join(nodes, "node").groupBy("component").agg(F.min("least").alias("component_id")),
                        "component").select("node", "component_id")
    # A fingerprint of one row without links names itself.
    alone = nodes.where("n > 1").join(linked, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    named = join_names(base, linked.union(alone), "node")
    return named.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"),
                        F.coalesce("component_id", "doc_id").alias("component_id"))
