"""As-of facts, and the fact layer that is described but not part of the default search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import memory_lines
from ..functions.text import plain_tokens
from ..plans.scan import carry_last
from ..plans.skew import first_row
from .search import vector_top_k

# Fact layer constants.
FACT_LIMIT = 30
SESSION_BOOST = 0.1
OVERLAP = 0.6
FACTS_A_PART = 512


def as_of(questions: DataFrame, facts: DataFrame, keys: Sequence[str], bucket: str = "day") -> DataFrame:
    """Latest fact of the key at or before the time of each question.

    ``questions`` is (question_id, …keys, ts), ``facts`` (…keys, ts, fact_id, value). Both are merged
    on the time line and the last fact is carried forward, so no question meets every fact of its
    key; time buckets keep one key spread over many tasks. Among equal times the highest fact id
    is the latest.
    """
    keys = list(keys)
    fact_type = facts.schema["fact_id"].dataType
    left = questions.select(*keys, "ts", F.lit(1).alias("_kind"), F.lit(None).cast(fact_type).alias("fact_id"),
                            "question_id", F.lit(None).cast(_payload(facts)).alias("_fact"))
    right = facts.select(*keys, "ts", F.lit(0).alias("_kind"), "fact_id",
                         F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"),
                         F.struct(F.col("ts").alias("fact_ts"), "fact_id", "value").alias("_fact"))
    merged = left.unionByName(right)
    carried = carry_last(merged, keys, F.date_trunc(bucket, "ts"), ["ts", "_kind", "fact_id"], F.col("_fact"), "_last")
    return carried.where(F.col("_kind") == 1).select(
        "question_id", *keys, "ts", F.col("_last.fact_ts").alias("fact_ts"),
        F.col("_last.fact_id").alias("fact_id"), F.col("_last.value").alias("value"))


def _payload(facts: DataFrame):
    return facts.select(F.struct(F.col("ts").alias("fact_ts"), "fact_id", "value").alias("p")).schema["p"].dataType


def atomic_facts(extractions: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """One row per memory line of an extraction, with its event date."""
    return extractions.select(*keep, F.posexplode(memory_lines(F.col(text_col))).alias("fact_index", "_f")).select(
        *keep, "fact_index", F.col("_f.line").alias("fact"), F.col("_f.event_date").alias("event_date"))


def fact_sessions(queries: DataFrame, facts: DataFrame, k: int = FACT_LIMIT) -> DataFrame:
    """Sessions of the ``k`` nearest facts ``(container, fact_id, session_id, embedding)``."""
    near = vector_top_k(queries, facts.withColumnRenamed("fact_id", "chunk_id"), k)
    ids = facts.select("container", F.col("fact_id").alias("chunk_id"), "session_id")
    return near.join(ids, ["container", "chunk_id"]).select("query_id", "container", "session_id").distinct()


def session_boost(hits: DataFrame, sessions: DataFrame, boost: float = SESSION_BOOST) -> DataFrame:
    """Add ``boost`` to the chunks of sessions that facts matched, and rank again."""
    flagged = hits.join(sessions.withColumn("_hit", F.lit(True)), ["query_id", "container", "session_id"], "left")
    boosted = flagged.withColumn(
        "score", F.round(F.col("score") + F.when(F.col("_hit"), boost).otherwise(0.0), 6)).drop("_hit", "rank")
    order = Window.partitionBy("query_id", "container").orderBy(F.col("score").desc(), "chunk_id")
    return boosted.withColumn("rank", F.row_number().over(order))


def inject_parent_chunks(hits: DataFrame, sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the chunks of fact-matched sessions that the search did not return, with score 0."""
    extra = sessions.join(chunks.select("container", "session_id", "chunk_id"), ["container", "session_id"])
    extra = extra.join(hits.select("query_id", "container", "chunk_id"), ["query_id", "container", "chunk_id"], "left_anti")
    return hits.unionByName(extra.withColumn("score", F.lit(0.0)), allowMissingColumns=True)


def merge_profile(facts: DataFrame, order: str = "ord", overlap: float = OVERLAP) -> DataFrame:
    """Drop a fact when a later fact of the same user shares at least ``overlap`` of its words.

    Overlap is shared words over the smaller word set (the measure is our choice). A pair can reach
    the mark only if it shares one of the rarest words of the smaller set (prefix filtering), so
    facts meet through those words and not all against all. A word that many facts of a user hold is split by its
    number of facts. All sides grow with the facts, so they meet by sorting and none is built in the driver.
    """
    def sorted_side(df: DataFrame) -> DataFrame:
        return df.hint("merge")

    rows = facts.select("user_id", "fact_id", order, F.array_sort(F.array_distinct(plain_tokens(F.col("fact")))).alias("_words"))
    rows = rows.where(F.size("_words") > 0)
    # Of facts with the same words only the latest stays, so copies never meet each other.
    unique = first_row(rows, ["user_id", "_words"], [F.col(order).desc(), F.col("fact_id").desc()])
    copies = rows.join(sorted_side(unique.select("user_id", "fact_id")), ["user_id", "fact_id"], "left_anti")
    words = unique.select("user_id", "fact_id", F.size("_words").alias("_n"), F.explode("_words").alias("word"))
    freq = words.groupBy("user_id", "word").agg(F.count("*").alias("_df"))
    ranked = words.join(sorted_side(freq), ["user_id", "word"]).withColumn(
        "_pos", F.row_number().over(Window.partitionBy("user_id", "fact_id").orderBy("_df", "word")))
    need = F.ceil(F.col("_n") * overlap - 1e-9)
    parts = F.ceil(F.col("_df") / FACTS_A_PART).cast("int")
    a = ranked.where(F.col("_pos") <= F.col("_n") - need + 1).select(
        "user_id", "word", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.col("fact_id").alias("small"),
        F.col("_n").alias("sn"))
    b = ranked.select("user_id", "word", F.pmod(F.xxhash64("fact_id"), parts).cast("int").alias("_part"),
                      F.col("fact_id").alias("big"), F.col("_n").alias("bn"))
    pairs = sorted_side(a).join(b, ["user_id", "word", "_part"]).where(
        (F.col("sn") <= F.col("bn")) & (F.col("small") != F.col("big"))
    ).select("user_id", "small", "sn", "big").distinct()

    def side(name: str, tag: str) -> DataFrame:
        return unique.select("user_id", F.col("fact_id").alias(name), F.col("_words").alias(f"{tag}w"),
                             F.struct(F.col(order), F.col("fact_id")).alias(f"{tag}at"))

    checked = (
        pairs.join(sorted_side(side("small", "s")), ["user_id", "small"])
        .join(sorted_side(side("big", "b")), ["user_id", "big"])
        .where(F.size(F.array_intersect("sw", "bw")) >= F.col("sn") * overlap - 1e-9)
    )
    stale = checked.select("user_id", F.when(F.col("sat") < F.col("bat"), F.col("small")).otherwise(F.col("big")).alias("fact_id"))
    stale = stale.unionByName(copies.select("user_id", "fact_id")).distinct()
    return facts.join(sorted_side(stale), ["user_id", "fact_id"], "left_anti")


# The seven query types a reranker may be told apart by, in order of precedence.
# Only the names are published; the patterns are ours.
QUERY_TYPES = (
    ("temporal", r"\b(when|what (date|day|time|year|month)|how long|before|after|first|last)\b"),
    ("knowledge-update", r"\b(current|currently|now|latest|most recent|still|changed?|updated?)\b"),
    ("preference", r"\b(prefer|preference|favou?rite|like|recommend|suggest)\b"),
    ("assistant-recall", r"\b(you (said|told|mentioned|suggested|recommended)|did you)\b"),
    ("multi-hop", r"\b(both|and also|who .* whose|relationship between)\b"),
    ("factual", r"\b(what|who|where|which|name)\b"),
)


def query_type(text: Column) -> Column:
    """One of seven query types; ``general`` when no pattern fits."""
    low = F.lower(text)
    out = F.lit("general")
    for name, pattern in reversed(QUERY_TYPES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out
