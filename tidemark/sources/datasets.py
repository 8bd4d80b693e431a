"""Conversation benchmark files to flat tables.

Every loader returns the same four tables, and the elements that could not be read. Files are cut into elements by several
tasks (``elements.py``). Ordinals come from the data, so they do not depend on how the files were split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_clock_date, parse_slash_date
from .elements import json_elements, parsed

# Question type per category number.
CATEGORY_TYPES = {
    1: "single-hop",
    2: "multi-hop",
    3: "temporal",
    4: "world-knowledge",
    5: "adversarial",
}


@dataclass(frozen=True)
class Dataset:
    """``messages`` (session_id, turn, role, text, speaker), ``sessions`` (session_id, date,
    formatted_date), ``questions``, the bridge ``question_sessions``, and ``unreadable`` (file, ord,
    value): elements that do not fit the layout, and files that end early (null ord and value)."""

    messages: DataFrame
    sessions: DataFrame
    questions: DataFrame
    question_sessions: DataFrame
    unreadable: DataFrame

    def types(self) -> DataFrame:
        """Question types that occur."""
        return self.questions.select("question_type").distinct()


def category_type(category: Column) -> Column:
    """Type name of a category number; an unknown number raises when the row is read."""
    pairs = [F.lit(x) for item in CATEGORY_TYPES.items() for x in item]
    found = F.get(F.map_values(F.map_filter(F.create_map(*pairs), lambda k, _: k == category)), F.lit(0))
    return F.coalesce(found, F.raise_error(
        F.concat(F.lit("unknown category: "), F.coalesce(category.cast("string"), F.lit("null")))).cast("string"))


def role_of(speaker: Column, first: Column) -> Column:
    """``user`` for the first speaker, else ``assistant``."""
    return F.when(speaker == first, "user").otherwise("assistant")


def role_of_name(speaker: Column) -> Column:
    """``user`` for a speaker of that name in any case, else ``assistant``."""
    return F.when(F.lower(speaker) == "user", "user").otherwise("assistant")


_POSITIONAL = (
    "question_id STRING, question STRING, answer STRING, question_type STRING, question_date STRING, "
    "haystack_dates ARRAY<STRING>, haystack_sessions ARRAY<ARRAY<STRUCT<role: STRING, content: STRING>>>"
)


def load_positional_sessions(spark: SparkSession, path: str) -> Dataset:
    """Files whose i-th session goes with the i-th date.

    The schema leaves out the answer marks some messages carry, so they are never read. Questions
    are positioned by file name, then id.
    """
    read, unreadable = parsed(json_elements(spark, path), _POSITIONAL)
    raw = read.withColumn("_file", F.substring_index("file", "/", -1)).where(
        F.coalesce(F.col("question_id"), F.lit("")) != "")
    each = raw.select("question_id", "haystack_dates", F.posexplode("haystack_sessions").alias("ord", "_messages"))
    session_id = F.concat("question_id", F.lit("-session-"), F.col("ord").cast("string"))
    date = parse_slash_date(F.get("haystack_dates", F.col("ord")))
    numbered = each.withColumn("session_id", session_id)
    question_date = parse_slash_date(F.col("question_date"))
    questions = raw.select(
        "question_id", "question", "question_type", F.col("answer").alias("ground_truth"),
        F.coalesce(question_date["iso"], F.col("question_date")).alias("question_date"),
        question_date["formatted"].alias("question_date_formatted"),
        F.struct(F.col("_file"), F.col("question_id")).alias("pos"),
    )
    return Dataset(
        numbered.select("session_id", F.posexplode("_messages").alias("turn", "_m")).select(
            "session_id", "turn", "_m.role", F.col("_m.content").alias("text"),
            F.lit(None).cast("string").alias("speaker")),
        numbered.select("session_id", date["iso"].alias("date"), date["formatted"].alias("formatted_date")),
        questions,
        numbered.select("question_id", "session_id", "ord"),
        unreadable,
    )


_KEYED = (
    "sample_id STRING, conversation MAP<STRING, STRING>, "
    "qa ARRAY<STRUCT<question: STRING, answer: STRING, evidence: ARRAY<STRING>, category: INT>>"
)
_TURNS = "array<struct<speaker:string,text:string>>"


def load_keyed_sessions(spark: SparkSession, path: str) -> Dataset:
    """Files with ``session_1 … session_N`` keys; reading stops at the first missing number.

    A session that is not a list is skipped without ending the sequence. All questions of a sample
    share its sessions.
    """
    raw, unreadable = parsed(json_elements(spark, path), _KEYED)
    # Entries, not the whole map, go on with each session.
    entries = raw.select("sample_id", F.element_at("conversation", "speaker_a").alias("speaker_a"),
                         F.element_at("conversation", "speaker_b").alias("speaker_b"),
                         F.explode("conversation").alias("_key", "_value"))
    number = F.regexp_extract("_key", r"^session_([1-9]\d*)(_date_time)?$", 1).try_cast("int")
    found = entries.withColumn("n", number).where(F.col("n").isNotNull()).groupBy("sample_id", "n").agg(
        F.first("speaker_a").alias("speaker_a"), F.first("speaker_b").alias("speaker_b"),
        F.max(F.when(~F.col("_key").endswith("_date_time"), F.col("_value"))).alias("_body"),
        F.max(F.when(F.col("_key").endswith("_date_time"), F.col("_value"))).alias("_stamp"))
    # The run of numbers from 1 on ends at the first that is missing.
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("n"))
    found = found.where(F.coalesce("_body", F.lit("")) != "").withColumn("_place", place).where(
        F.col("_place") == F.col("n"))
    found = found.withColumn("_turns", F.from_json("_body", _TURNS)).where(
        F.col("_body").startswith("[") & F.col("_turns").isNotNull())
    session_id = F.concat("sample_id", F.lit("-session_"), F.col("n").cast("string"))
    date = parse_clock_date(F.col("_stamp"))
    numbered = found.withColumn("session_id", session_id)
    qa = raw.select("sample_id", F.posexplode("qa").alias("i", "_q"))
    question_id = F.concat("sample_id", F.lit("-q"), F.col("i").cast("string"))
    questions = qa.select(
        question_id.alias("question_id"), "_q.question", category_type(F.col("_q.category")).alias("question_type"),
        F.col("_q.answer").alias("ground_truth"), "sample_id", "_q.evidence",
        F.struct(F.col("sample_id"), F.col("i")).alias("pos"),
    )
    return Dataset(
        numbered.select("session_id", F.col("speaker_a").alias("_first"), F.posexplode("_turns").alias("turn", "_m")).select(
            "session_id", "turn", role_of(F.col("_m.speaker"), F.col("_first")).alias("role"),
            F.col("_m.text").alias("text"), F.col("_m.speaker").alias("speaker")),
        numbered.select("session_id", date["iso"].alias("date"), date["formatted"].alias("formatted_date"),
                        "speaker_a", "speaker_b"),
        questions,
        qa.select("sample_id", question_id.alias("question_id")).join(
            numbered.select("sample_id", "session_id", F.col("n").alias("ord")), "sample_id").drop("sample_id"),
        unreadable,
    )


_EVIDENCE = (
    "category STRING, item STRUCT<question: STRING, answer: STRING, "
    "message_evidences: ARRAY<STRUCT<speaker: STRING, text: STRING>>, "
    "conversations: ARRAY<STRUCT<messages: ARRAY<STRUCT<speaker: STRING, text: STRING>>>>>"
)


def load_evidence_items(spark: SparkSession, path: str, prefix: str = "convomem") -> Dataset:
    """Files holding one list of evidence items; ids carry the item's place in the list, and the
    file's name where one folder holds several files."""
    elements = json_elements(spark, path)
    several = len(spark.read.text(path).inputFiles()) > 1
    read, unreadable = parsed(elements, _EVIDENCE)
    name = F.concat(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1), F.lit("-")) if several else F.lit("")
    question_id = F.concat(F.lit(f"{prefix}-"), name, F.col("category"), F.lit("-"), F.col("ord").cast("string"))
    items = read.select(F.col("ord").cast("int").alias("i"), question_id.alias("question_id"), "category", "item")
    talks = items.select("question_id", F.posexplode("item.conversations").alias("ord", "_c"))
    talks = talks.withColumn("session_id", F.concat("question_id", F.lit("-session-"), F.col("ord").cast("string")))
    return Dataset(
        talks.select("session_id", F.posexplode("_c.messages").alias("turn", "_m")).select(
            "session_id", "turn", role_of_name(F.col("_m.speaker")).alias("role"),
            F.col("_m.text").alias("text"), F.lit(None).cast("string").alias("speaker")),
        talks.select("session_id", F.lit(None).cast("string").alias("date"),
                     F.lit(None).cast("string").alias("formatted_date")),
        items.select("question_id", F.col("item.question").alias("question"), F.col("category").alias("question_type"),
                     F.col("item.answer").alias("ground_truth"), F.col("item.message_evidences").alias("evidence"),
                     F.col("i").alias("pos")),
        talks.select("question_id", "session_id", "ord"),
        unreadable,
    )


def strip_answer_leak(sessions: DataFrame, column: str = "messages", field: str = "has_answer") -> DataFrame:
    """Remove the answer mark from every message struct."""
    return sessions.withColumn(column, F.transform(column, lambda m: m.dropFields(field)))
