"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only lengths decide a packing, and there are no more of them than the capacity. So the counts per length are packed as
whole groups of equal bins, which gives a small plan however many documents there are; documents then look their place
up by their rank among those of equal length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
# Words a worker remembers; it starts anew beyond that.
REMEMBERED = 300_000
# Longer words are encoded each time.
LONGEST = 64
# Pieces of one length that are numbered in one task.
RUN = 200_000
# Texts whose pieces are handed on together.
TOGETHER = 1000
_UNEVEN = re.compile(r" \s|\s ")

# Fixed value: how byte-level vocabularies of this kind cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Words of these characters are cut alike by every reading of the pattern.
_PLAIN = re.compile(r"[ \n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in
    order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked_encoder(path: str):
    """The vocabulary as merge ranks for the faster library; None unless its ids follow its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = _byte_letters()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if not made or any(x >= y for x, y in zip(made, made[1:])) or not letters.keys() <= model["vocab"].keys():
        return None
    words = [*letters, *(a + b for a, b in merges)]
    ranks = {bytes(letters[c] for c in word): model["vocab"][word] for word in words}
    return tiktoken.Encoding("from file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Words:
    """Token ids of texts, word by word.

    The byte-level pattern always cuts before a single space between other characters, so such a text's ids are those
    of its words, each with its leading space; it also cuts between a letter and a full stop or comma. Texts with white
    space beside a space are encoded whole. New words of ASCII and Latin letters go through the same merges in a faster
    library, all others through the tokenizer itself. A text that holds the string of an added token is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked_encoder(path)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # ids of a space and the word

    def _encode(self, text: str) -> bytes:
        if self.ranked is not None and _PLAIN.fullmatch(text):
            return np.asarray(self.ranked.encode_ordinary(text), "<u4").tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        if len(word) > LONGEST:
            return self._encode(word)
        held, name = (self.spaced, word[1:]) if word[:1] == " " else (self.known, word)
        ids = held.get(name)
        if ids is None:
            closed = len(word) > 2 and word[-1] in ".," and word[-2].isascii() and word[-2].isalpha()
            ids = held[name] = self._learn(word[:-1]) + self._learn(word[-1]) if closed else self._encode(word)
        return ids

    def __call__(self, text: str) -> bytes:
        if any(map(text.__contains__, self.special)):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) + len(self.spaced) > REMEMBERED:
            self.known, self.spaced = {}, {}
        if text.replace("\n", "").isprintable():  # then spaces and line feeds are all the white space there is
            uneven = "  " in text or " \n" in text or "\n " in text
        else:
            uneven = _UNEVEN.search(text)
        if uneven or text[:1].isspace() or text[-1:].isspace():
            return self._encode(text)
        first, *rest = text.split(" ")
        ids = list(map(self.spaced.get, rest))
        if None in ids:
            ids = [self._learn(" " + word) if found is None else found for word, found in zip(rest, ids, strict=True)]
        return self._learn(first) + b"".join(ids)


_loaded: dict[str, _Words] = {}


def _words(path: str | None) -> _Words:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: token ids of each document and ``end``, cut only beyond the capacity.

    The first piece takes what the full ones leave. ``path`` names the tokenizer's file where the workers run.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a in range(0, len(ids), TOGETHER):
                rows: list[tuple] = []
                for name, text in zip(ids[a:a + TOGETHER], texts.slice(a, TOGETHER).to_pylist(), strict=True):
                    raw = words(text or "") + tail
                    n = len(raw) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    rows += [(name, k, x, y - x, zlib.crc32(raw[4 * x:4 * y]))
                             for k, (x, y) in enumerate(zip(edges, edges[1:]))]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                                                    strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass(frozen=True)
class Plan:
    """Sorted segments: pieces of ``length`` with ranks from ``first`` on go to bins ``base``, ``base`` + 1, ..."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    bins: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack counts of lengths.

    Lengths above a third of the capacity are matched first, at most two to a bin: the longest with the longest other
    that still fits. The rest go by falling length into the smallest gap that holds them, and open bins only when none
    does.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    taken = np.zeros(capacity + 1, np.int64)
    segments: list[tuple[int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first bin, bins) by free space
    waiting = np.zeros(capacity + 1, bool)
    bins = 0

    def put(length: int, count: int, base: int, offset: int) -> None:
        segments.append((length, int(taken[length]), base, offset))
        taken[length] += count
        left[length] -= count

    def free(gap: int, base: int, count: int) -> None:
        if gap and count:
            gaps[gap].append((base, count))
            waiting[gap] = True

    third = capacity // 3
    for long in range(capacity, third, -1):
        while left[long]:
            mates = np.flatnonzero(left[third + 1:min(long, capacity - long) + 1]) + third + 1
            if len(mates) and mates[-1] == long and left[long] == 1:
                mates = mates[:-1]
            mate = int(mates[-1]) if len(mates) else 0
            many = int(left[long] if not mate else left[long] // 2 if mate == long else min(left[long], left[mate]))
            put(long, many, bins, 0)
            if mate:
                put(mate, many, bins, long)
            free(capacity - long - mate, bins, many)
            bins += many
    for short in range(third, 0, -1):
        while left[short]:
            fitting = np.flatnonzero(waiting[short:])
            if len(fitting):
                gap = int(fitting[0]) + short
                base, count = gaps[gap].pop()
                many = int(min(count, left[short]))
                put(short, many, base, capacity - gap)
                free(gap - short, base, many)
                free(gap, base + many, count - many)
                waiting[gap] = bool(gaps[gap])
            else:
                each = capacity // short
                full, rest = divmod(int(left[short]), each)
                for many, height in ((full, each), (1, rest)):
                    for k in range(height if many else 0):
                        put(short, many, bins, k * short)
                    if height:
                        free(capacity - height * short, bins, many)
                        bins += many
    table = np.array(sorted(segments), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], bins)


def ranked(cut: DataFrame, counts: dict[int, int], run: int = RUN) -> DataFrame:
    """Adds ``rank``, from 0 within each length; the pieces of a frequent length are numbered in several tasks."""
    parts = max(16, -(-max(counts.values(), default=1) // run))
    spread = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        spread.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each for itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, path), "pieces")
    counts = {int(r["length"]): r["count"] for r in cut.groupBy("length").count().collect()}  # one row per length
    shared = spark.sparkContext.broadcast(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = shared.value
        wide = np.int64(1) << 50
        keys = p.length * wide + p.first
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(p.base[at] + rank - p.first[at]), pa.array(p.offset[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(cut, counts).mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
               "offset bigint")
