"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max bounds, then overlap checks.

Scores are divided by the item's own (the score of the item as its own passage), so one threshold fits items of any
length. Items are kept in classes by length; the passages of a class are windows of twice its longest item, a window's
half apart, so that every place where an item can stand lies whole inside one passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Rolling, shingle_hashes, text_slices, word_spans

K1, B = 1.2, 0.75
# Items per block of the index.
BLOCK = 16
# Postings that one broadcast part of the index holds; a larger index is searched part by part.
PART_POSTINGS = 2_000_000
# Words are runs of letters and digits; every byte of a longer UTF-8 character counts as a letter.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, owner = word_spans(data, offsets, GAP)
    return Rolling(data)(starts, stops), owner


def _grams(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Distinct word triples and their width; of fewer words the whole sequence."""
    width = min(3, len(words))
    return width, np.unique(shingle_hashes(words, np.zeros(len(words), np.int64), max(width, 1))[0])


@dataclass(frozen=True)
class LengthClass:
    """Inverted index of the items of one length class, terms as columns of sorted arrays."""

    stride: int                 # longest item of the class, in words
    items: np.ndarray           # item ids
    terms: np.ndarray           # sorted word hashes
    bound: np.ndarray           # largest impact of each term
    edge: np.ndarray            # postings of term t: edge[t] to edge[t + 1]
    item: np.ndarray            # posting: place in ``items``, ascending inside a term
    impact: np.ndarray
    block_edge: np.ndarray      # block-max entries of term t
    block: np.ndarray
    block_bound: np.ndarray
    question: list[tuple[int, np.ndarray]]  # word triples of the first two thirds of each item
    answer: list[tuple[int, np.ndarray]]    # and of the rest


def _index(rows: list[tuple[int, list[int], list[int], list[float]]], stride: int) -> LengthClass:
    """rows: item id, words in order, distinct terms, their normalised impacts."""
    rows = sorted(rows, key=lambda r: r[0])
    term = np.concatenate([np.asarray(r[2], np.int64).view(np.uint64) for r in rows])
    place = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    impact = np.concatenate([np.asarray(r[3], np.float64) for r in rows])
    order = np.lexsort((place, term))
    term, place, impact = term[order], place[order], impact[order]
    names, edge = np.unique(term, return_index=True)
    cut = np.ones(len(term), bool)
    cut[1:] = (term[1:] != term[:-1]) | (place[1:] // BLOCK != place[:-1] // BLOCK)
    at = np.flatnonzero(cut)
    words = [np.asarray(r[1], np.int64).view(np.uint64) for r in rows]
    third = [max(1, (2 * len(w) + 2) // 3) for w in words]
    return LengthClass(
        stride, np.array([r[0] for r in rows]), names, np.maximum.reduceat(impact, edge), np.append(edge, len(term)),
        place, impact, np.searchsorted(at, np.append(edge, len(term))), place[at] // BLOCK,
        np.maximum.reduceat(impact, at), [_grams(w[:c]) for w, c in zip(words, third, strict=True)],
        [_grams(w[c:]) for w, c in zip(words, third, strict=True)])


def item_postings(items: DataFrame) -> DataFrame:
    """item_id, words (hashes in order) of every item that has a word."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column("text")):
                words, owner = _words(data, offsets)
                edge = np.searchsorted(owner, np.arange(stop - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_id").slice(first, stop - first),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(words.view(np.int64)))],
                    names=["item_id", "words"])

    return items.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower("text").alias("text")).mapInArrow(
        read, "item_id bigint, words array<bigint>").where(F.size("words") > 0).distinct()


def weighted(items: DataFrame) -> DataFrame:
    """item_id, words, terms, impacts: BM25 weights over all items, divided by the item's own score."""
    base = items.withColumn("dl", F.size("words"))
    n, mean = base.agg(F.count("*"), F.avg("dl")).first()
    one = base.select("item_id", "words", "dl", F.explode("words").alias("term")).groupBy(
        "item_id", "words", "dl", "term").agg(F.count("*").alias("tf"))
    spread = one.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (mean or 1.0)))
    return (
        one.join(spread, "term").withColumn("raw", raw)
        .groupBy("item_id", "words").agg(F.sum("raw").alias("own"), F.collect_list("term").alias("terms"),
                                         F.collect_list("raw").alias("raws"))
        .select("item_id", "words", "terms", F.transform("raws", lambda x: x / F.col("own")).alias("impacts"))
    )


def build_parts(items: DataFrame) -> Iterator[list[LengthClass]]:
    """The index, in parts of about PART_POSTINGS postings each."""
    whole = weighted(item_postings(items)).persist()
    total = whole.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-total // PART_POSTINGS))
    for part in range(parts if total else 0):
        classes: dict[int, list] = {}
        for row in whole.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toLocalIterator():
            classes.setdefault(max(8, 1 << (len(row.words) - 1).bit_length()), []).append(tuple(row))
        yield [_index(rows, stride) for stride, rows in sorted(classes.items())]
    whole.unpersist()


def _passages(owner: np.ndarray, stride: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of every window of 2 * stride words, stride apart, of each text."""
    edge = np.searchsorted(owner, np.arange(n + 1))
    size = np.diff(edge)
    count = np.where(size > 0, np.maximum(1, -(-(size - stride) // stride)), 0)
    text = np.repeat(np.arange(n), count)
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = edge[text] + turn * stride
    return first, np.minimum(first + 2 * stride, edge[text + 1])


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source range, position) of every position in the given ranges."""
    size = stops - starts
    source = np.repeat(np.arange(len(starts)), size)
    return source, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - starts, size)


def search(index: LengthClass, words: np.ndarray, owner: np.ndarray, n: int,
           threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, end, item place, score) of all passages and items whose score reaches ``threshold``.

    Bounds in three steps, none of which can lose a hit: the sum of the terms' largest impacts over a passage, the
    same sum per block of items, and the scores of the items in the blocks that are left.
    """
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = index.terms[at] == words
    weight = np.where(known, index.bound[at], 0.0)
    first, stop = _passages(owner, index.stride, n)
    sums = np.concatenate([[0.0], np.cumsum(weight)])
    slack = 1e-9
    hopeful = np.flatnonzero(sums[stop] - sums[first] >= threshold - slack)
    for a in range(0, len(hopeful), 4096):
        chosen = hopeful[a:a + 4096]
        passage, word = _ranges(first[chosen], stop[chosen])
        use = known[word]
        pair = np.unique(passage[use] * len(index.terms) + at[word[use]])
        passage, term = pair // len(index.terms), pair % len(index.terms)
        left = np.bincount(passage, weights=index.bound[term], minlength=len(chosen)) >= threshold - slack
        keep = left[passage]
        passage, term = passage[keep], term[keep]
        blocks = len(index.items) // BLOCK + 1
        source, entry = _ranges(index.block_edge[term], index.block_edge[term + 1])
        cell = passage[source] * blocks + index.block[entry]
        names, inverse = np.unique(cell, return_inverse=True)
        alive = names[np.bincount(inverse, weights=index.block_bound[entry], minlength=len(names)) >= threshold - slack]
        if not len(alive):
            continue
        source, entry = _ranges(index.edge[term], index.edge[term + 1])
        cell = passage[source] * blocks + index.item[entry] // BLOCK
        live = alive[np.minimum(np.searchsorted(alive, cell), len(alive) - 1)] == cell
        cell = passage[source[live]] * len(index.items) + index.item[entry[live]]
        names, inverse = np.unique(cell, return_inverse=True)
        score = np.bincount(inverse, weights=index.impact[entry[live]], minlength=len(names))
        for k in np.flatnonzero(score >= threshold):
            p = chosen[names[k] // len(index.items)]
            yield int(owner[first[p]]), int(first[p]), int(stop[p]), int(names[k] % len(index.items)), float(score[k])


def _share(part: tuple[int, np.ndarray], words: np.ndarray) -> float:
    """Share of the part's word sequences that the passage holds; an empty part is held."""
    width, wanted = part
    if not len(wanted):
        return 1.0
    return float(np.isin(wanted, shingle_hashes(words, np.zeros(len(words), np.int64), width)[0]).mean())


def _hits(texts: pa.Array, classes: list[LengthClass], threshold: float, overlap: float,
          most: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item id, score, question overlap, answer overlap) of one batch of lower-case texts."""
    for first, stop, data, offsets in text_slices(texts):
        words, owner = _words(data, offsets)
        for index in classes if len(words) else ():
            for text, a, b, item, score in search(index, words, owner, stop - first, threshold):
                both = index.question[item], index.answer[item]
                parts = [_share(part, words[a:b]) for part in both]
                size = [len(wanted) for _, wanted in both]
                # A large part of the item counts whichever of its two parts it lies in.
                if min(parts) >= overlap or sum(size) and np.dot(size, parts) >= most * sum(size):
                    yield first + text, int(index.items[item]), score, *parts


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5,
                 most: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document that holds a test item.

    Case and punctuation do not count. A passage of the document must reach ``threshold`` of the item's own BM25 score
    and hold at least ``overlap`` of the word triples of both parts of the item: the first two thirds of its words as
    the question, the rest as the answer; or ``most`` of the triples of both together, so that a leak of two thirds of an
    item counts whichever part it spares. Clean documents give no row. Null or empty texts and items without words match
    nothing; long texts are read whole, window by window; repeated documents and items give one row per pair of ids; no
    documents or no items: no rows. Scores reach a limit or not, so there are no ties; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for classes in build_parts(items):
        shared = spark.sparkContext.broadcast(classes)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_hits(batch.column("text"), shared.value, threshold, overlap, most))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()),
                     *(pa.array(c, pa.float64()) for c in columns[2:])],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = found.union(texts.mapInArrow(scan, schema))
    return found.groupBy("doc_id", "item_id").agg(*(
        F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5, most: float = 0.6) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item."""
    lowered = "lower of text"
    for classes in build_parts(items):
        shared = docs.sparkSession.sparkContext.broadcast(classes)

        def sift(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                hit[[h[0] for h in _hits(batch.column(lowered), shared.value, threshold, overlap, most)]] = True
                yield batch.drop_columns([lowered]).filter(pa.array(~hit))

        docs = docs.withColumn(lowered, F.lower("text")).mapInArrow(sift, docs.schema)
    return docs
