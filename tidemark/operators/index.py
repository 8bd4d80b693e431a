"""Building and updating the retrieval index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bm25_tokens, term_runs
from ..plans.skew import first_row, fits, spread_few_files


@dataclass(frozen=True)
class Index:
    """Tables of one retrieval index; ``container`` is the first key of each.

    ``forward`` (container, chunk_id, dl, terms), where the index comes from texts, is one row a chunk.
    """

    chunks: DataFrame
    postings: DataFrame
    stats: DataFrame
    forward: DataFrame | None = None

    def term_df(self) -> DataFrame:
        """Number of chunks per (container, term)."""
        return self.postings.groupBy("container", "term").agg(F.count("*").alias("df"))

    def doc_len(self) -> DataFrame:
        """Token count per chunk, zero-token chunks included."""
        return self.chunks.select("container", "chunk_id", F.size(bm25_tokens(F.col("content"))).alias("dl"))


def term_counts(texts: DataFrame, id_col: str, text_col: str, tokens) -> DataFrame:
    """``(container, <id>, dl, term, tf)`` from the tokens of each text.

    A text is one row, so its terms are counted inside the row: no shuffle, but for a scan of fewer
    files than cores, whose texts are spread first.
    """
    rows = spread_few_files(texts.select("container", id_col, F.col(text_col).alias("_text")), "container", id_col)
    return rows.select(
        "container", id_col, F.explode(term_runs(tokens(F.col("_text")))).alias("_t")
    ).select("container", id_col, "_t.dl", "_t.term", "_t.tf")


def postings(chunks: DataFrame) -> DataFrame:
    """``(container, term, chunk_id, tf, dl)``."""
    return term_counts(chunks, "chunk_id", "content", bm25_tokens).select("container", "term", "chunk_id", "dl", "tf")


def forward_rows(chunks: DataFrame) -> DataFrame:
    """``(container, chunk_id, dl, terms)``: the counted terms of each chunk as one row, chunks without any included."""
    rows = spread_few_files(chunks.select("container", "chunk_id", "content"), "container", "chunk_id")
    return rows.select("container", "chunk_id", term_runs(bm25_tokens(F.col("content"))).alias("terms")).withColumn(
        "dl", F.coalesce(F.get("terms.dl", F.lit(0)), F.lit(0)))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """``(container, n_docs, total_len, avgdl)``."""
    texts = spread_few_files(
        chunks.select("container", "chunk_id", F.col("content").alias("_text")), "container", "chunk_id")
    return (
        texts.select("container", F.size(bm25_tokens(F.col("_text"))).alias("dl"))
        .groupBy("container")
        .agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_len"))
        .withColumn("avgdl", F.col("total_len") / F.col("n_docs"))
    )


def index_chunks(chunks: DataFrame) -> Index:
    """Index of ready chunks ``(container, chunk_id, content, …)``."""
    forward = forward_rows(chunks)
    listed = forward.select("container", "chunk_id", F.inline("terms")).select("container", "term", "chunk_id", "dl", "tf")
    stats = forward.groupBy("container").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_len")).withColumn(
        "avgdl", F.col("total_len") / F.col("n_docs"))
    return Index(chunks, listed, stats, forward)


def _line() -> Column:
    return F.concat(F.col("role"), F.lit(": "), F.col("text"))


def transcripts(messages: DataFrame) -> DataFrame:
    """One text per session: ``role: text`` lines in turn order.

    ``messages`` has (container, session_id, turn, role, text). A transcript is one value, so a task
    gathers the session it writes; chunks do not need it (``chunk_sessions``).
    """
    return (
        messages.groupBy("container", "session_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", _line().alias("line")))).alias("_lines"))
        .select("container", "session_id",
                F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("content"))
    )


_BLANK = " \t\n\x0b\x0c\r"


def _streamed_sentences(lines: Iterator[str], size: int, overlap: int) -> Iterator[str]:
    """What ``sentence_chunks`` makes of the joined lines, holding one window of them."""
    text, last, some = "", False, False
    while True:
        while not last and len(text) < size + 2:
            line = next(lines, None)
            if line is None:
                last = True
            else:
                text, some = text + "\n" + line if some else line, True
        if last and len(text) <= size:
            yield text.strip(_BLANK)
            return
        whole, start = text[:size + 2].rfind(". "), text[:size + 1]
        for at, least in ((whole, size * 0.5), (start.rfind("\n"), size * 0.5), (start.rfind(" "), 0)):
            if at > 0 and at >= least:
                break
        else:
            at = size
        taken = size + 1 if at + 1 - overlap <= 0 else at + 1
        yield text[:taken].strip(_BLANK)
        text = text[taken - overlap:]
        if last and not text:
            return


def chunk_sessions(messages: DataFrame, size: int = 1600, overlap: int = 320) -> DataFrame:
    """(container, session_id, chunk_index, content): sentence chunks of every session's transcript.

    The turns of a session come sorted and are read through a window of one chunk, so a session of
    any length gives the chunks of its whole text and no task gathers it.
    """
    schema = T.StructType([messages.schema["container"], messages.schema["session_id"],
                           T.StructField("chunk_index", T.LongType()), T.StructField("content", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in groupby(rows(batches), key=lambda r: r[:2]):
            lines = (line for _, _, line in group if line is not None)
            number = 0
            for first, piece in enumerate(_streamed_sentences(lines, size, overlap)):
                # An empty piece counts only where it is the whole text.
                if piece or first == 0:
                    out.append((*key, number, piece))
                    number += 1
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=schema.names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=schema.names)

    lined = messages.select("container", "session_id", "turn", _line().alias("line"))
    return (
        lined.repartition("container", "session_id").sortWithinPartitions("container", "session_id", "turn", "line")
        .select("container", "session_id", "line").mapInArrow(cut, schema)
    )


def build_index(messages: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None,
                size: int = 1600, overlap: int = 320) -> Index:
    """Transcript, chunk, embed and count: the whole ingest as one plan.

    ``embed`` takes the chunk frame and returns it with an ``embedding`` column.
    """
    chunks = chunk_sessions(messages, size, overlap).withColumn(
        "chunk_id", F.concat_ws("_", "container", F.col("session_id").cast("string"),
                                F.col("chunk_index").cast("string"))
    )
    return index_chunks(embed(chunks) if embed else chunks)


def upsert_chunks(existing: DataFrame, new: DataFrame, version: str | None = None) -> DataFrame:
    """Replace rows of ``existing`` by rows of ``new`` with the same chunk id.

    Rows of ``new`` win; inside ``new`` the highest ``version`` column wins, if one is named, then a
    hash of the row. Keys of a batch measured to fit are sent to the stored rows, which then stay
    where they are.
    """
    key = ["container", "chunk_id"]
    order = ([F.col(version).desc()] if version else []) + [F.xxhash64(*new.columns)]
    fresh = first_row(new, key, order)
    names = fresh.select(*key)
    kept = existing.join(F.broadcast(names) if fits(names) else names, key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def clear_container(df: DataFrame, containers: DataFrame) -> DataFrame:
    """Drop every row of the named containers."""
    return df.join(containers.select("container"), "container", "left_anti")


def list_containers(chunks: DataFrame) -> DataFrame:
    """Visible containers with their kind; names holding ``-v1.`` or ``_abs-`` are hidden."""
    return (
        chunks.select("container").distinct()
        .where(~F.col("container").contains("-v1.") & ~F.col("container").contains("_abs-"))
        .withColumn("kind", F.when(F.col("container").startswith("repo-"), "repo").otherwise("personal"))
    )


def session_chunks(chunks: DataFrame, container: str, session_id) -> DataFrame:
    """Chunks of one session in order."""
    return chunks.where((F.col("container") == container) & (F.col("session_id") == session_id)).orderBy(
        "chunk_index"
    )


def container_counts(chunks: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks, nodes and edges per container, with a has-data flag."""
    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("container").agg(F.count("*").alias(name))

    joined = (
        tally(chunks, "n_chunks")
        .join(tally(entities, "n_nodes"), "container", "full")
        .join(tally(edges, "n_edges"), "container", "full")
    )
    return joined.fillna(0, ["n_chunks", "n_nodes", "n_edges"]).withColumn(
        "has_data", F.col("n_chunks") > 0
    )

