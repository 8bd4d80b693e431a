"""Near duplicates: SetSketch bands propose, the joint likelihood sifts, full shingle sets confirm."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .components import components
from .kernels import LOWER, Rolling, mix, shingle_hashes, text_slices, word_spans
from .tables import stored

WIDTH = 5
# Members of one bucket that meet in one task; larger buckets are compared block against block.
BLOCK = 1024
# Five standard errors of the estimate below the limit.
SIFT = 0.5


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text) of every distinct shingle, sorted by text and shingle."""
    data = LOWER[data]
    n = len(offsets) - 1
    starts, stops, owner = word_spans(data, offsets)
    words = Rolling(data)(starts, stops)
    shingles, first = shingle_hashes(words, owner, width)
    owner_of = owner[first]
    # A text with fewer words is one shingle: its whole sequence.
    count = np.bincount(owner, minlength=n)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        edge = np.searchsorted(owner, few)
        whole = np.array([_fold(words[a:a + count[k]]) for a, k in zip(edge, few, strict=True)], np.uint64)
        shingles, owner_of = np.concatenate([shingles, whole]), np.concatenate([owner_of, few])
    order = np.lexsort((shingles, owner_of))
    shingles, owner_of = shingles[order], owner_of[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner_of[1:] != owner_of[:-1])
    return shingles[new], owner_of[new]


def _fold(words: np.ndarray) -> np.uint64:
    value = np.full(1, 0xD6E8FEB86659FD93 + len(words), np.uint64)
    for k in range(len(words)):
        value = mix(value) + words[k:k + 1]
    return mix(value)[0]


def _node(shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit name per set, the same for equal sets (whatever the order of their members)."""
    size = np.bincount(owner, minlength=n).astype(np.uint64)
    total = np.zeros(n + 1, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(0xA0761D6478BD642F)))])
    total = sums[np.searchsorted(owner, np.arange(n), "right")] - sums[np.searchsorted(owner, np.arange(n))]
    return mix(total ^ mix(size + np.uint64(1)))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, node (name of the shingle set, null if empty), n_shingles, registers: one pass, one row per document."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column("text")):
                shingles, owner = _sets(data, offsets, width)
                size = np.bincount(owner, minlength=stop - first)
                cells = setsketch.registers(shingles, owner, stop - first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, stop - first),
                    pa.array(_node(shingles, owner, stop - first).view(np.int64), mask=size == 0),
                    pa.array(size.astype(np.int64)),
                    pa.array([row.tobytes() for row in cells], pa.binary()),
                ], names=["doc_id", "node", "n_shingles", "registers"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        sketch, "doc_id bigint, node bigint, n_shingles bigint, registers binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of every band of every set."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(batch.column("registers"))
            for a in range(0, len(cells), 2000):
                keys = setsketch.bands(cells[a:a + 2000])
                node = batch.column("node").slice(a, 2000).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(node, setsketch.BANDS))],
                    names=["bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(spread, "bucket bigint, node bigint")


def _cells(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(-1, setsketch.REGISTERS)


def _likely(pairs: DataFrame, sift: float) -> DataFrame:
    """Pairs whose estimated similarity is ``sift`` or more."""
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                similarity = setsketch.joint_similarity(
                    _cells(batch.column("a")), _cells(batch.column("b")),
                    batch.column("size_a").to_numpy().astype(float), batch.column("size_b").to_numpy().astype(float))
                yield batch.select(["hub", "node"]).filter(pa.array(similarity >= sift))

    return pairs.mapInArrow(estimate, "hub bigint, node bigint")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal (non-null) keys as one batch; holds one group, as Arrow slices."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new), batch.num_rows]
        for x, y in zip(edges, edges[1:]):
            own = tuple(c[x] for c in columns)
            if own != name and held:
                yield pa.concat_batches(held)
                held = []
            name = own
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.concat_batches(held)


def _linked(common: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (size + sizes - common)


def _confirm_stars(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between each hub and the members that are similar enough; rows come sorted, the hub first."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, u, v = None, None, [], []
        for batch in batches:
            sets = batch.column("shingles")
            for k, (name, part, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "node")),
                                                       strict=True)):
                mine = sets[k].values.to_numpy()
                if node == name:
                    hub, own = (name, part), mine
                elif hub == (name, part):
                    common = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(mine) - common):
                        u.append(name)
                        v.append(node)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
            u, v = [], []

    return rows.mapInArrow(check, "u bigint, v bigint")


def _meet(members: DataFrame, payload: DataFrame, column: str, compare: Callable, schema: str) -> DataFrame:
    """Bring the members of a bucket together, block against block, and apply ``compare`` to each meeting."""
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    met = (
        members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component")
        .join(payload.select("node", "n_shingles", column), "node")
        .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "i", "j"]):
            if group.num_rows > 1:
                yield from compare(group)

    return met.mapInArrow(run, schema)


def _maybe(sift: float, percent: int) -> Callable:
    """Members with a partner of another component that their registers do not rule out."""
    def compare(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells = _cells(group.column("registers"))
        sizes, home = group.column("n_shingles").to_numpy(), group.column("component").to_numpy()
        kept = np.zeros(len(sizes), bool)
        for k in range(len(sizes)):
            fits = (home != home[k]) & (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k]))
            at = np.flatnonzero(fits)
            at = at[(cells[at] == cells[k]).sum(axis=1) >= (sift - 0.05) * cells.shape[1]]
            if len(at):
                kept[k] = kept[at] = True
        yield group.select(["bucket", "node"]).filter(pa.array(kept))

    return compare


def _exact(percent: int) -> Callable:
    """Links between members of different components; one link suffices to join two components of a meeting."""
    def compare(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, sizes = group.column("node").to_numpy(), group.column("n_shingles").to_numpy()
        _, home = np.unique(group.column("component").to_numpy(), return_inverse=True)
        # Components of this meeting; joining two renames one of them in ``home``.
        _, place = np.unique(group.column("shingles").flatten().to_numpy(), return_inverse=True)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        held = np.zeros(place.max() + 1, bool)
        u, v = [], []
        for k in range(len(node) - 1):
            rest = home[k + 1:] != home[k]
            if not rest.any():
                continue
            mine = place[edge[k]:edge[k + 1]]
            held[mine] = True
            common = np.add.reduceat(held[place[edge[k + 1]:]], edge[k + 1:-1] - edge[k + 1], dtype=np.int64)
            held[mine] = False
            for m in np.flatnonzero(rest & _linked(common, sizes[k], sizes[k + 1:], percent)) + k + 1:
                if home[m] != home[k]:
                    home[home == home[m]] = home[k]
                    u.append(node[k])
                    v.append(node[m])
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return compare


def _shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n_shingles, shingles of the wanted (doc_id, node)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column("text")):
                shingles, owner = _sets(data, offsets, width)
                node = _node(shingles, owner, stop - first).view(np.int64)
                edge = np.searchsorted(owner, np.arange(stop - first + 1)).astype(np.int32)
                # A repeated doc_id may bring a text of another set along: leave that row out.
                right = node == batch.column("node").slice(first, stop - first).to_numpy()
                out = pa.RecordBatch.from_arrays([
                    pa.array(node), pa.array(np.diff(edge).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(shingles.view(np.int64)))],
                    names=["node", "n_shingles", "shingles"])
                yield out.filter(pa.array(right))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id").select(
        "text", "node").mapInArrow(build, "node bigint, n_shingles bigint, shingles array<bigint>"
                                   ).dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 75, sift: float = SIFT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    Documents are linked if their sets of ``width``-word shingles have 100 * intersection >= percent * union. Equal
    sets are one node from the start, so copies are never paired. Sketch buckets link each member with the bucket's
    first; the estimate drops hopeless pairs and the full sets decide. Buckets that still hold several components
    are compared in full, block against block, so that every pair that shares a band is settled.

    Null, empty and white-space texts have no shingles and stand alone, as do rows without doc_id (component_id null,
    kept true). Repeated rows are equal sets. An empty table gives an empty result; other columns are not read.
    """
    base = stored(sketches(docs, width), "sketches")
    named = base.where("node is not null and doc_id is not null")
    nodes = stored(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
                                             F.first("registers").alias("registers")), "nodes")
    rows = _buckets(nodes)
    multi = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"),
                                       F.count("*").alias("size")).where("hub < last").drop("last")
    members = stored(rows.join(multi, "bucket"), "members")
    pairs = members.where("node != hub").select("hub", "node").distinct()
    cells = nodes.select("node", "n_shingles", "registers")
    likely = stored(_likely(
        pairs.join(cells.toDF("node", "size_b", "b"), "node").join(cells.toDF("hub", "size_a", "a"), "hub")
        .where("100 * least(size_a, size_b) >= %d * greatest(size_a, size_b)" % percent), sift), "likely")

    def sets_of(names: DataFrame) -> DataFrame:
        return _shingle_sets(docs, nodes.select("doc_id", "node").join(names, "node", "left_semi"), width)

    sets = stored(sets_of(likely.select("node").union(likely.select("hub")).distinct()), "sets")
    parts = likely.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    spoke = likely.join(parts, "hub").select(
        "hub", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
    centre = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                          F.col("hub").alias("node"))
    links = _confirm_stars(
        spoke.union(centre).join(sets, "node").select("hub", "part", "node", "shingles")
        .repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node") != F.col("hub")), percent)
    links = stored(links, "links")
    home = stored(components(links), "home")

    placed = members.where("size > 2").join(home, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")
                                                ).where("a < b").select("bucket")
    residue = stored(placed.join(open_buckets, "bucket", "left_semi").select("bucket", "size", "node", "component"),
                     "residue")
    maybe = stored(_meet(residue, cells, "registers", _maybe(sift, percent), "bucket bigint, node bigint").distinct(),
                   "maybe")
    if not maybe.isEmpty():
        more = sets.select("node").join(maybe, "node", "left_semi")
        missing = maybe.select("node").distinct().join(more, "node", "left_anti")
        every = sets.union(sets_of(missing))
        late = stored(_meet(residue.join(maybe, ["bucket", "node"]), every, "shingles", _exact(percent),
                            "u bigint, v bigint"), "late")
        if not late.isEmpty():
            home = stored(components(links.union(late)), "home")

    known = base.select("doc_id", "node", "n_shingles").join(home, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    first = known.where("component is not null and doc_id is not null").groupBy("component").agg(
        F.min("doc_id").alias("first"))
    return known.join(first, "component", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


# The same rows by counting shared shingles of all pairs: for small tables only.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n"""
