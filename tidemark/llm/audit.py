"""Interaction of text filters: what each one removes in every order, with exact duplicates found by radix tries.

Masks. One pass over the texts works out which of the filters A to D each fails. Copies inside an Arrow batch are set aside
there, so a batch sends every different text once, with a name of the copies and their least id.

Tries. Texts are range-partitioned by a prefix that is made longer where too many bytes begin alike, and sorted. A task
inserts whole texts into a compressed trie whose terminals hold the least id and the names; texts in order only touch the
last path, so a trie that has grown too large is walked and begun again with its last text. A walk hands each name its
text's least id; a row with a greater id fails filter E.

Reduction. Rows become counts per (part, mask, labels), some hundred cells a part, from which all orders follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Rolling, per_text, text_slices, word_spans
from .tables import stored

FILTERS = "ABCDE"
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#$%&*|")] = True
# Code points of the first prefix; each further one is four times as long.
PREFIX = 16
# A prefix is made longer if more than one of so many bytes lie under it; at most that many are.
SHARE = 4096
# Bytes of edge labels of one trie, and of the texts that one range should hold.
TRIE_BYTES = 32 << 20
NONE = np.iinfo(np.int64).max


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    parts = [np.zeros(0, np.int32)]
    for first, stop, data, offsets in text_slices(texts):
        n = stop - first
        starts, stops, owner = word_spans(data, offsets)
        count = np.bincount(owner, minlength=n)
        words = Rolling(data)(starts, stops)
        order = np.lexsort((words, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = per_text(fresh, owner[order], n).astype(np.int64)

        def within(marks: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])

        upper, points = within((data >= 65) & (data <= 90)), within((data & 0xC0) != 0x80)
        parts.append((count < 200).astype(np.int32) | (100 * distinct < 50 * count) << 1 | (100 * upper > 2 * points) << 2
                     | (within(SIGNS[data]) > 0) << 3)
    return np.concatenate(parts)


class Trie:
    """A compressed trie: an inner node maps a first character to (edge label, node); a terminal has an entry."""

    def __init__(self) -> None:
        self.children: list[dict[str, list]] = [{}]
        self.entry: dict[int, list] = {}
        self.size = 0

    def _grow(self) -> int:
        self.children.append({})
        return len(self.children) - 1

    def insert(self, text: str) -> list:
        """The entry (least id, names) of ``text``."""
        node, at = 0, 0
        while at < len(text):
            edge = self.children[node].get(text[at])
            if edge is None:
                below = self._grow()
                self.children[node][text[at]] = [text[at:], below]
                self.size += len(text) - at
                node, at = below, len(text)
            elif text.startswith(edge[0], at):
                node, at = edge[1], at + len(edge[0])
            else:
                # Part the edge where the text leaves it.
                low, high = 1, min(len(edge[0]), len(text) - at)
                while low < high:
                    middle = (low + high + 1) // 2
                    if text.startswith(edge[0][:middle], at):
                        low = middle
                    else:
                        high = middle - 1
                between = self._grow()
                self.children[between][edge[0][low]] = [edge[0][low:], edge[1]]
                edge[0], edge[1] = edge[0][:low], between
                node, at = between, at + low
        return self.entry.setdefault(node, [NONE, []])

    def walk(self) -> Iterator[list]:
        """Every entry, terminal by terminal in text order of the branches."""
        open_ = [0]
        while open_:
            node = open_.pop()
            if node in self.entry:
                yield self.entry[node]
            open_ += [below for _, below in self.children[node].values()]


def _minima(size: int):
    """(name, least) of every name: rows come sorted by text."""
    def flags(entries: list[list]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(entries), 10_000):
            some = entries[a:a + 10_000]
            counts = [len(e[1]) for e in some]
            least = np.repeat(np.array([e[0] for e in some], np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.fromiter((n for e in some for n in e[1]), np.int64, sum(counts))),
                 pa.array(least, mask=least == NONE)], names=["name", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = Trie(), None
        for batch in batches:
            for text, name, least in zip(batch.column("text"), batch.column("name").to_pylist(),
                                         batch.column("least").to_pylist(), strict=True):
                text = text.as_py()
                entry = trie.insert(text)
                if least is not None:
                    entry[0] = min(entry[0], least)
                entry[1].append(name)
                last = text
                if trie.size > size:
                    # Only the last text can come again.
                    yield from flags([e for e in trie.walk() if e is not entry])
                    trie = Trie()
                    trie.insert(last)[:] = entry
                    trie.size = 0
        yield from flags(list(trie.walk()))

    return run


def _passed(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, name, least, text: one row per document; its text only where it stands for its copies in the
    batch, whose name and least id it carries."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            has = ~pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            kinds = pc.dictionary_encode(texts)
            code = kinds.indices.to_numpy()
            mask = text_masks(kinds.dictionary)[code]
            first = np.unique(code, return_index=True)[1]
            least = np.full(len(kinds.dictionary), NONE)
            np.minimum.at(least, code[has], ids[has].astype(np.int64))
            stands = np.zeros(batch.num_rows, bool)
            stands[first] = True
            name = batch.column("row").to_numpy()[first][code]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(mask.astype(np.int32)), pa.array(name),
                 pa.array(least[code], mask=least[code] == NONE), pc.if_else(pa.array(stands), texts, pa.scalar(None, texts.type))],
                names=["doc_id", "part", "mask", "name", "least", "text"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(scan, "doc_id bigint, part string, mask int, name bigint, least bigint, text string")


def _prefix(length: int):
    """A prefix as a number. Two prefixes of one number are parted later or not at all; equal texts stay together."""
    return F.xxhash64(F.left("text", F.lit(length)))


def _heavy(level: tuple[int, list[int]]):
    return F.expr(f"xxhash64(left(text, {level[0]})) IN ({', '.join(map(str, level[1]))})")


def adaptive_prefixes(texts: DataFrame, total: int, prefix: int = PREFIX, share: int = SHARE) -> list[tuple[int, list[int]]]:
    """(length, prefixes) that too many of the ``total`` bytes lie under, level by level: at most ``share`` numbers a level,
    whatever the data. A prefix of one text only cannot be parted and is not listed."""
    levels: list[tuple[int, list[int]]] = []
    rows = texts.select("text")
    while True:
        whole = F.xxhash64("text")
        heavy = rows.groupBy(_prefix(prefix).alias("head")).agg(
            F.sum(F.octet_length("text")).alias("bytes"), F.min(whole).alias("a"), F.max(whole).alias("b")
        ).where((F.col("bytes") * share > total) & (F.col("a") < F.col("b")))
        found = [r["head"] for r in heavy.select("head").collect()]
        if not found:
            return levels
        levels.append((prefix, found))
        rows = rows.where(_heavy(levels[-1]))
        prefix *= 4


def _head(levels: list[tuple[int, list[int]]], prefix: int):
    """The number of the shortest prefix of a text that is not too heavy."""
    head = _prefix(prefix * 4 ** len(levels))
    for level in reversed(levels):
        head = F.when(_heavy(level), head).otherwise(_prefix(level[0]))
    return head


def least_ids(texts: DataFrame, prefix: int = PREFIX, share: int = SHARE, size: int = TRIE_BYTES) -> DataFrame:
    """name, least: the least id (``least``) over all rows of the same text, for every name.

    A text that a third of all rows hold is one row a batch here, and its terminal holds numbers only.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = adaptive_prefixes(texts, total, prefix, share)
    ranges = max(-(-total // size), texts.sparkSession.sparkContext.defaultParallelism)
    return (
        texts.select("text", "name", "least").repartitionByRange(int(ranges), F.left("text", F.lit(prefix)), _head(levels, prefix))
        .sortWithinPartitions("text").mapInArrow(_minima(size), "name bigint, least bigint")
    )


def masks(docs: DataFrame, prefix: int = PREFIX, share: int = SHARE, size: int = TRIE_BYTES) -> DataFrame:
    """doc_id, part, mask (five bits, A lowest) of every row.

    A null text counts as empty, a null source as the empty string. E: the text is that of a row with a smaller doc_id; a
    row without doc_id neither fails it nor makes another fail, and rows with equal ids are no duplicates of each other.
    """
    rows = stored(_passed(docs), "masks")
    texts = rows.where("text is not null")
    least = stored(least_ids(texts, prefix, share, size).toDF("name", "whole"), "least")
    late = F.coalesce(F.col("doc_id") > F.coalesce("whole", "least"), F.lit(False))
    # Names are of one batch each, so none is hot.
    return rows.drop("text").join(least, "name").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(late, 16).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: at most 128 rows a part. A document is good or toxic if any of its labels says so."""
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Counted before the join, so that a repeated id is few rows; rows without one need no join.
    counted = masked.where("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    no = F.lit(False)
    found = counted.join(named, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")
    bare = masked.where("doc_id is null").select("part", "mask", no.alias("good"), no.alias("toxic"), F.lit(1).cast("bigint").alias("n"))
    return found.unionByName(bare).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the cells."""
    names = ["".join(p) for p in permutations(FILTERS)]
    place = [(name, step, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in name[:step]))
             for name in names for step, f in enumerate(name)]
    at = F.explode(F.sequence(F.lit(0), F.lit(len(place) - 1)))

    def looked_up(k: int):
        return F.element_at(F.lit([p[k] for p in place]), F.col("at") + 1)

    wide = counts.withColumn("at", at).withColumn("bit", looked_up(2)).withColumn("before", looked_up(3))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    out = fails & ~gone

    def total(where):
        return F.sum(F.when(where, F.col("n")).otherwise(0)).cast("bigint")

    # A filter is the first of m failing ones in one of m orders.
    share = F.lit(factorial(len(FILTERS))) / F.bit_count("mask")
    return wide.groupBy("part", "at").agg(
        total(~fails & ~gone).alias("kept"), total(out).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(out & F.col("good")).alias("good_lost"),
        total(out & F.col("toxic")).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("bigint")).otherwise(0)).cast("bigint").alias("shapley"),
    ).select("part", looked_up(0).alias("filter_order"), (looked_up(1) + 1).cast("int").alias("step"), "kept", "removed",
             "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row per source, order of the five filters and step, zeros included. Texts of any length are read whole; repeated
    rows count each; copies of a text fail E but for those with its least doc_id. An empty table has no parts and gives no
    rows. Columns other than doc_id, source and text (labels: doc_id, quality, toxic) are not read.
    """
    return orders(cells(masks(docs), labels))


ORACLE_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lows AS (SELECT t, min(doc_id) AS low FROM worded GROUP BY t),
masked AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask
  FROM worded JOIN lows USING (t)),
named AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM masked LEFT JOIN named USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
perms AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS before
  FROM perms, range(1, 6) r(s)),
one AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(n) FILTER (mask & bit > 0 AND mask & before = 0 AND good) AS good_lost,
    sum(n) FILTER (mask & bit > 0 AND mask & before = 0 AND toxic) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM one"""
