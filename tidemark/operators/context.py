"""Context texts for an answering model, one per query, from ranked rows.

Every layout gathers the ranked rows of one query, which the search cut to k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..plans.skew import first_row


def _joined(order: str, line: Column, separator: str) -> Column:
    rows = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order).alias("at"), line.alias("line")))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), separator)


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def tagged_memories(rows: DataFrame, order: str = "rank", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Chunk blocks, and the entity and relationship lists, from rows tagged by ``row_type``."""
    kind = F.coalesce("row_type", F.lit("chunk"))
    date = _filled(F.coalesce(_filled(F.col("date")), F.col("memory_date")))

    def attribute(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f' {name}="'), _filled(value), F.lit('"')), F.lit(""))

    chunk = F.when(~kind.isin("entity", "relationship", "profile"), F.concat(
        F.lit('<memory session="'), F.col("session_id").cast("string"), F.lit('"'), attribute("date", date),
        attribute("eventDate", F.col("event_date")), F.lit(">\n"), F.col("content"), F.lit("\n</memory>")))
    entity = F.when(kind == "entity", F.concat(
        F.lit("- "), F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit("): "), F.col("content")))
    dated = F.coalesce(F.concat(F.lit(" ["), _filled(F.col("date")), F.lit("]")), F.lit(""))
    relation = F.when(kind == "relationship", F.concat(
        F.lit("- "), F.col("source"), F.lit(" -"), F.col("relation"), F.lit("-> "), F.col("target"), dated))
    out = rows.groupBy(*by).agg(
        _joined(order, chunk, "\n\n").alias("chunks"),
        _joined(order, entity, "\n").alias("_e"),
        _joined(order, relation, "\n").alias("_r"),
        F.max_by(F.when(kind == "profile", F.col("content")), F.when(kind == "profile", F.col(order))).alias("_p"),
    )
    block_e = F.when(F.col("_e") != "", F.concat(F.lit("<entities>\n"), F.col("_e"), F.lit("\n</entities>")))
    block_r = F.when(F.col("_r") != "", F.concat(F.lit("<relationships>\n"), F.col("_r"), F.lit("\n</relationships>")))
    return out.select(
        *by,
        F.when(F.col("chunks") != "", F.col("chunks")).otherwise("No relevant memory chunks retrieved.").alias("chunks"),
        F.concat_ws("\n", block_e, block_r).alias("graph_context"),
        F.coalesce("_p", F.lit("")).alias("profile_context"),
    )


def facts_and_entities(rows: DataFrame, order: str = "rank", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Facts with their event time, then entities, as two bodies.

    ``fact_lines`` and ``entity_lines`` go between the caller's own headings.
    """
    node = F.coalesce(F.col("row_type") == "node", F.lit(False))
    entity = F.when(node, F.concat(F.lit("  - "), F.coalesce(_filled(F.col("name")), F.lit("Unknown")), F.lit(": "),
                                   F.coalesce("summary", F.lit(""))))
    fact = F.when(~node, F.concat(F.lit("  - "), F.col("fact"), F.lit(" (event_time: "),
                                  F.coalesce(_filled(F.col("valid_at")), F.lit("unknown")), F.lit(")")))
    return rows.groupBy(*by).agg(
        _joined(order, fact, "\n").alias("fact_lines"), _joined(order, entity, "\n").alias("entity_lines")
    )


def numbered_memories(rows: DataFrame, order: str = "rank", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """``[n] [Timestamp: …] text`` blocks; ``order`` counts from 1."""
    stamp = F.coalesce(F.concat(F.lit(" [Timestamp: "), _filled(F.col("date")), F.lit("]")), F.lit(""))
    line = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("]"), stamp, F.lit(" "), F.col("content"))
    return rows.groupBy(*by).agg(_joined(order, line, "\n\n").alias("context"))


def memories_with_chunks(rows: DataFrame, chunks: DataFrame, order: str = "rank",
                         by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Result blocks, then their chunks once each, by position.

    ``chunks`` is (…by, content, position, seq); of equal contents the first by ``seq`` stays.
    """
    by = list(by)
    times = F.concat_ws(" | ", F.concat(F.lit("documentDate: "), _filled(F.col("document_date"))),
                        F.concat(F.lit("eventDate: "), _filled(F.col("event_date"))))
    block = F.concat_ws("\n", F.concat(F.lit("Result "), F.col(order).cast("string"), F.lit(":")),
                        F.coalesce("memory", F.lit("")),
                        F.when(times != "", F.concat(F.lit("Temporal Context: "), times)))
    head = rows.groupBy(*by).agg(_joined(order, block, "\n\n---\n\n").alias("_head"))
    once = first_row(chunks.where(trim_space(F.col("content")) != ""), [*by, "content"], [F.col("seq")])
    tail = once.groupBy(*by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "seq", "content"))),
                                 lambda r: r["content"]), "\n\n---\n\n").alias("_tail"))
    return head.join(tail, by, "left").select(*by, F.concat(
        F.col("_head"),
        F.coalesce(F.concat(F.lit("\n\n=== DEDUPLICATED CHUNKS ===\n"), F.col("_tail")), F.lit("")),
    ).alias("context"))


def memory_files(rows: DataFrame, order: str = "rank", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """File blocks headed by number, session and relevance in percent."""
    percent = F.floor(F.col("score") * 100 + 0.5).cast("bigint").cast("string")
    line = F.concat(F.lit("=== Memory File "), F.col(order).cast("string"), F.lit(": "),
                    F.col("session_id").cast("string"), F.lit(" (relevance: "), percent, F.lit("%) ===\n"),
                    F.col("content"))
    return rows.groupBy(*by).agg(_joined(order, line, "\n\n---\n\n").alias("context"))


def raw_json(rows: DataFrame, columns: Sequence[str], order: str = "rank",
             by: Sequence[str] = ("query_id",)) -> DataFrame:
    """All result rows of a query as one JSON array."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.struct(*columns).alias("row"))))
    return rows.groupBy(*by).agg(F.to_json(F.transform(packed, lambda r: r["row"])).alias("context"))


def speaker_transcript(messages: DataFrame, by: Sequence[str] = ("session_id",), turn: str = "turn"
                       ) -> DataFrame:
    """``speaker [timestamp]: text`` lines per session; the role stands in for a missing speaker."""
    stamp = F.coalesce(F.concat(F.lit(" ["), _filled(F.col("timestamp")), F.lit("]")), F.lit(""))
    line = F.concat(F.coalesce(_filled(F.col("speaker")), F.col("role")), stamp, F.lit(": "), F.col("text"))
    return messages.groupBy(*by).agg(_joined(turn, line, "\n").alias("transcript"))


def json_transcript(messages: DataFrame, by: Sequence[str] = ("session_id",), turn: str = "turn",
                    date: str | None = None) -> DataFrame:
    """Messages as a JSON array with escaped angle brackets, after an optional date line."""
    rows = F.sort_array(F.collect_list(F.struct(
        F.col(turn).alias("at"), F.struct(F.col("role"), F.col("text").alias("content")).alias("m"))))
    body = F.to_json(F.transform(rows, lambda r: r["m"]))
    body = F.replace(F.replace(body, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first_date = F.min(date) if date else F.lit(None).cast("string")
    out = messages.groupBy(*by).agg(body.alias("_body"), first_date.alias("_date"))
    intro = F.coalesce(F.concat(F.lit("Here is the date the following session took place: "),
                                _filled(F.col("_date")), F.lit("\n\n")), F.lit(""))
    return out.select(*by, F.concat(
        intro, F.lit("Here is the session as a stringified JSON:\n"), F.col("_body")).alias("transcript"))
