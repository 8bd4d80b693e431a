"""Language identification by prediction by partial matching: code lengths of whole texts under byte context trees.

A tree per language counts which byte follows each context of up to ORDER bytes. A byte's cost is that of its longest
known context; one not seen there pays the context's escape (distinct / (total + distinct), method C) and is looked up
one byte shorter, down to 8 bits for a byte never seen at all. The statistics are frozen, so a byte and its context have
one exact cost per language, worked out beforehand for every string that any tree holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import text_slices

ORDER = 3
FOLDS = 5


def held_out() -> F.Column:
    """Whether a document belongs to the fifth that is never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0


def _strings(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each position, as one number (the first byte highest)."""
    n = len(data) - size + 1
    code = np.zeros(max(n, 0), np.uint32)
    for k in range(size):
        code = (code << np.uint32(8)) | data[k:k + len(code)]
    return code


class Table:
    """Numbers of known strings of one size, by open addressing at a quarter load."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.row = np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.row[slot] < 0
            self.row[slot[free]] = todo[free]  # of several for one slot the last stays
            done = self.row[slot] == todo
            self.keys[slot[done]] = keys[todo[done]]
            todo, slot = todo[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Row of each string, -1 if unknown."""
        slot = self._slot(codes)
        found = self.row[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[slot] != codes))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            row = self.row[slot]
            settled = (row < 0) | (self.keys[slot] == codes[open_])
            found[open_[settled]] = row[settled]
            open_, slot = open_[~settled], slot[~settled]
        return found


@dataclass(frozen=True)
class Trees:
    """Frozen statistics of all languages; level m is about strings of m bytes."""

    languages: list[str]
    tables: list[Table]
    cost: list[np.ndarray]    # string x language: bits of its last byte after the others
    escape: list[np.ndarray]  # string x language: bits of an escape from it as context

    def text_bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language (texts x languages)."""
        count = len(self.languages)
        bits = np.zeros((len(data), count), np.float32)
        depth = np.full(len(data), ORDER + 1, np.int8)
        for k in range(ORDER):
            near = offsets[:-1] + k
            near = near[near < offsets[1:]]
            depth[near] = k + 1  # the first bytes of a text have shorter contexts
        late: np.ndarray = np.zeros(0, np.int64)
        for size in range(ORDER + 1, 0, -1):
            ends = np.concatenate([np.flatnonzero(depth == size), late])
            if not len(ends):
                continue
            row = self.tables[size](_strings(data, size)[ends - size + 1])
            known = row >= 0
            bits[ends[known]] += self.cost[size][row[known]]
            late = ends[~known]
            if not len(late):
                continue
            if size == 1:
                bits[late] += 8 + self.escape[0][0]
            else:
                context = self.tables[size - 1](_strings(data, size - 1)[late - size + 1])
                seen = context >= 0
                bits[late[seen]] += self.escape[size - 1][context[seen]]
        sums = np.zeros((len(data) + 1, count))
        np.cumsum(bits, axis=0, out=sums[1:], dtype=np.float64)
        return sums[offsets[1:]] - sums[offsets[:-1]]


def build(languages: list[str], counts: list[dict[str, np.ndarray]]) -> Trees:
    """counts[m]: arrays ``code``, ``lang`` (place in ``languages``) and ``n`` of all strings of m bytes, from m = 1."""
    width = len(languages)
    keys = [np.zeros(1, np.uint32)] + [np.unique(c["code"]) for c in counts[1:]]
    grids = [np.zeros((1, width))]
    for m in range(1, len(keys)):
        grid = np.zeros((len(keys[m]), width))
        np.add.at(grid, (np.searchsorted(keys[m], counts[m]["code"]), counts[m]["lang"]), counts[m]["n"])
        grids.append(grid)
    tables, cost, escape = [Table(keys[0])], [np.full((1, width), 8.0)], []
    for m in range(len(keys)):
        total, distinct = np.zeros((len(keys[m]), width)), np.zeros((len(keys[m]), width))
        if m + 1 < len(keys):
            context = np.searchsorted(keys[m], keys[m + 1] >> np.uint32(8))
            np.add.at(total, context, grids[m + 1])
            np.add.at(distinct, context, grids[m + 1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape.append(np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0.0))
            if m + 1 < len(keys):
                tail = keys[m + 1] & np.uint32((1 << (8 * m)) - 1)
                shorter = escape[m][context] + cost[m][np.searchsorted(keys[m], tail)]
                own = -np.log2(grids[m + 1] / (total + distinct)[context])
                cost.append(np.where(grids[m + 1] > 0, own, shorter))
                tables.append(Table(keys[m + 1]))
    return Trees(languages, tables, [c.astype(np.float32) for c in cost], [e.astype(np.float32) for e in escape])


def train(docs: DataFrame, rows: int = 400) -> Trees:
    """Count the contexts of at most ``rows`` documents a language, those whose ids hash lowest, outside the held-out
    fifth. Rows without a language, id or text teach nothing."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (
        named.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("lang", "doc_id")
        .withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= rows).select("lang", "doc_id").distinct()
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, stop, data, offsets in text_slices(batch.column("text")):
                for k in range(stop - first):
                    own = data[offsets[k]:offsets[k + 1]]
                    for size in range(1, ORDER + 2):
                        code, n = np.unique(_strings(own, size), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([langs[first + k]] * len(code), pa.string()),
                             pa.array(np.full(len(code), size, np.int32)), pa.array(code.astype(np.int64)), pa.array(n)],
                            names=["lang", "size", "code", "n"])

    sample = named.join(F.broadcast(picked), ["lang", "doc_id"])  # at most ``rows`` ids a language
    table = (
        sample.dropDuplicates(["lang", "doc_id"]).mapInArrow(count, "lang string, size int, code bigint, n bigint")
        .groupBy("lang", "size", "code").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = np.asarray(table["lang"].to_pylist(), object)
    languages = sorted(set(langs))
    place = np.searchsorted(languages, langs.astype(str)) if languages else np.zeros(0, np.int64)
    size, code, n = (table[c].to_numpy() for c in ("size", "code", "n"))
    counts = [{}] + [{"code": code[size == m].astype(np.uint32), "lang": place[size == m], "n": n[size == m]}
                     for m in range(1, ORDER + 2)]
    return build(languages, counts)


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The prediction is the language with the shortest code for the whole text (the first by name on a tie), the score
    its share of 2 ** -bits. Null texts and texts without a letter are ``und`` with score 0, as is everything when
    nothing was learned. A null doc_id is not held out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123)]] = True

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trees = shared.value
        for batch in batches:
            texts = batch.column("text")
            pred: list[str] = []
            score: list[float] = []
            for first, stop, data, offsets in text_slices(texts):
                seen = np.concatenate([[0], np.cumsum(letters[data])])[offsets]
                plain = seen[1:] > seen[:-1]
                for k in np.flatnonzero(~plain):
                    plain[k] = any(map(str.isalpha, texts[first + int(k)].as_py() or ""))
                if model.languages:
                    bits = model.text_bits(data, offsets)
                    best = bits.argmin(axis=1)
                    gap = bits - bits[np.arange(len(bits)), best][:, None]
                    sure = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
                else:
                    plain[:] = False
                pred += [model.languages[best[k]] if plain[k] else "und" for k in range(stop - first)]
                score += [float(sure[k]) if plain[k] else 0.0 for k in range(stop - first)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(
        name, "doc_id bigint, held_out boolean, lang_pred string, score double")
