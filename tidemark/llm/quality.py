"""Quality rules: fixed counts of words, symbols and repeats, and a trained verdict on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import (SPACE, Rolling, mix, owners, per_text, shingle_hashes, text_slices, word_spans)
from .linear import Linear, fit

# One half of the features is for character trigrams, the other for words and word pairs.
HALF = 1 << 16
CHARS = 3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_BLANKS = " \t\n\x0b\x0c\r"


def _features(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, owner: np.ndarray):
    """(text, feature) of every character trigram and of every word and word pair."""
    n = len(data) - CHARS + 1
    if n > 0:
        wide = data.astype(np.uint32)
        gram = (wide[:n] << 16) | (wide[1:n + 1] << 8) | wide[2:]
        place = (gram * np.uint32(2654435761)) >> np.uint32(16)
        inside = np.ones(n, bool)
        for k in range(1, CHARS):
            inside[np.clip(offsets[1:-1] - k, 0, n - 1)] = False
        at = np.flatnonzero(inside)
        at = at[owners(at, offsets) == owners(at + CHARS - 1, offsets)]
        chars = owners(at, offsets), place[at].astype(np.int64)
    else:
        chars = np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair, first = shingle_hashes(words, owner, 2)
    value = np.concatenate([mix(words), pair])
    return chars, (np.concatenate([owner, owner[first]]), HALF + (value >> np.uint64(48)).astype(np.int64))


def _read(data: np.ndarray, offsets: np.ndarray):
    starts, stops, owner = word_spans(data, offsets)
    return starts, stops, owner, Rolling(data)(starts, stops)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the sampled texts, as relative frequencies."""
    for batch in batches:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for first, stop, data, offsets in text_slices(batch.column("text")):
            _, _, owner, words = _read(data, offsets)
            for_chars, for_words = _features(data, offsets, words, owner)
            for k in range(stop - first):
                index, value = [], []
                for who, place in (for_chars, for_words):
                    own = place[np.searchsorted(who, k):np.searchsorted(who, k, "right")] if place is for_chars[1] \
                        else place[who == k]
                    name, count = np.unique(own, return_counts=True)
                    index.append(name)
                    value.append(count / max(len(own), 1))
                found.append((np.concatenate(index), np.concatenate(value)))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "target": batch.column("target"),
            "index": pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())),
            "value": pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
        })


def train(docs: DataFrame, labels: DataFrame, rows: int = 3000) -> Linear:
    """Fit the verdict on at most ``rows`` labelled documents, those whose ids hash lowest.

    A quarter of them, again by hash, calibrates the probability. Unlabelled documents and null labels are left out;
    a document labelled twice counts as poor if any label says so.
    """
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("target"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``rows`` pairs of numbers
        .dropDuplicates(["doc_id"])
        .mapInArrow(_training_rows, "doc_id bigint, target int, index array<int>, value array<float>")
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model as one row. Fitted by a task, since the sample's features are many times the driver's share."""
        held = list(batches)
        if not held:
            held = [pa.RecordBatch.from_arrays([pa.array([], t) for t in (
                pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))],
                names=["doc_id", "target", "index", "value"])]
        rows = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
        index, value = (rows[c].combine_chunks() for c in ("index", "value"))
        ids = rows["doc_id"].to_numpy()
        sizes = np.diff(index.offsets.to_numpy()) if len(index) else np.zeros(0, np.int64)
        held_out = mix(ids.astype(np.uint64) + np.uint64(17)) % np.uint64(4) == 0
        model = fit(np.repeat(np.arange(len(ids), dtype=np.int32), sizes), index.flatten().to_numpy(),
                    value.flatten().to_numpy(), rows["target"].to_numpy().astype(float), 2 * HALF, held_out=held_out)
        yield pa.RecordBatch.from_pydict({
            "weights": pa.array([model.weights.tobytes()], pa.binary()),
            **{k: pa.array([getattr(model, k)], pa.float64()) for k in ("intercept", "slope", "shift")}})

    one = sample.repartition(1).mapInArrow(fitted, "weights binary, intercept double, slope double, shift double").first()
    return Linear(np.frombuffer(one["weights"]), one["intercept"], one["slope"], one["shift"])


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    for k in range(len(out)):
        lines = raw[offsets[k]:offsets[k + 1]].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    out[k] += 1
                elif line.strip(_BLANKS.encode()):
                    seen.add(line)
    return out


def _repeated_words(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of three words that occur twice or more in their text."""
    window, first = shingle_hashes(words, owner, 3)
    window = mix(window + owner[first].astype(np.uint64))
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    marked = np.zeros(len(words), bool)
    for hit in (first[order[1:][same]], first[order[:-1][same]]):
        for k in range(3):
            marked[hit + k] = True
    return per_text(marked, owner, n).astype(np.int64)


def _judged(texts: pa.Array, linear: Linear, threshold: float) -> dict[str, np.ndarray]:
    """Counts and verdicts of one batch of texts."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "p_good")
    parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0),) * len(names)]
    for first, stop, data, offsets in text_slices(texts):
        n = stop - first
        starts, stops, owner, words = _read(data, offsets)
        inked = ~SPACE[data] & ((data & 0xC0) != 0x80)
        chars = np.diff(np.concatenate([[0], np.cumsum(inked)])[offsets])
        signs = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[data])])[offsets])
        count = np.bincount(owner, minlength=n)
        margin = np.zeros(n)
        for who, place in _features(data, offsets, words, owner):
            margin += per_text(linear.weights[place], who, n) / np.maximum(np.bincount(who, minlength=n), 1)
        parts.append((count, chars, signs, _repeated_lines(data, offsets), _repeated_words(words, owner, n),
                      linear.probability(margin)))
    out = dict(zip(names, (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))
    out |= {name: out[name].astype(np.int64) for name in names[:-1]}
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["p_good"] >= threshold)
    return out


def score(docs: DataFrame, model: Linear, threshold: float = 0.5) -> DataFrame:
    """Every document's counts and verdict, in one pass without a shuffle.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good. A null or
    empty text has no words and fails the base rule. Texts are read whole; repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judged(batch.column("text"), shared.value, threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[n]) for n in names)],
                                             names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        judge, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
               "n_repeat_words bigint, base_failed boolean, kept boolean, p_good double")


def accepted(docs: DataFrame, model: Linear, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judged(batch.column("text"), shared.value, threshold)["kept"]))

    return docs.mapInArrow(sift, docs.schema)
