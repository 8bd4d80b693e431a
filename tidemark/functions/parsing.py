"""Columns that read model output: verdicts, JSON arrays, extraction sections, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_space

# Rubric names in order of precedence, each with the type fragments that select it.
RUBRICS = (
    ("abstention", ("abstention", "adversarial")),
    ("temporal", ("temporal",)),
    ("update", ("update", "changing")),
    ("preference", ("preference",)),
)


def judge_rubric(question_type: Column) -> Column:
    """Name of the rubric that judges a question type."""
    low = F.lower(question_type)
    out = F.lit("default")
    for name, marks in reversed(RUBRICS):
        hit = low.contains(marks[0])
        for mark in marks[1:]:
            hit = hit | low.contains(mark)
        out = F.when(hit, name).otherwise(out)
    return out


def truth_label(question_type: Column) -> Column:
    """Heading of the expected answer in a judge prompt."""
    return F.when(F.lower(question_type).contains("preference"), "Rubric").otherwise(
        "Ground Truth Answer"
    )


def parse_verdict(text: Column) -> Column:
    """``struct(score, label, explanation)`` from a judge reply.

    The widest ``{…}`` is read as JSON. Score counts only if it is exactly the number 1. Replies
    without usable JSON are correct when they quote "correct" and nowhere "incorrect".
    """
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # Inside brackets the parser also rejects text after the first object.
    doc = F.try_parse_json(F.when(body != "", F.concat(F.lit("["), body, F.lit("]"))))
    low = F.lower(text)
    guess = low.contains('"correct"') & ~low.contains('"incorrect"')

    def parsed(v: Column) -> Column:
        is_number = ~F.schema_of_variant(F.try_variant_get(v, "$[0].score", "variant")).isin("STRING", "BOOLEAN")
        score = F.when(is_number, F.try_variant_get(v, "$[0].score", "double"))
        label = F.try_variant_get(v, "$[0].label", "string")
        note = F.try_variant_get(v, "$[0].explanation", "string")
        return F.when(
            v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull(),
            F.struct(
                F.when(score == 1, 1).otherwise(0).alias("score"),
                F.when(label == "correct", "correct").otherwise("incorrect").alias("label"),
                F.coalesce(note, F.lit("")).alias("explanation"),
            ),
        ).otherwise(
            F.struct(
                guess.cast("int").alias("score"),
                F.when(guess, "correct").otherwise("incorrect").alias("label"),
                F.lit("Failed to parse judge response").alias("explanation"),
            )
        )

    return let(doc, parsed)


def parse_json_array(text: Column, element: str) -> Column:
    """The widest ``[…]`` as an array of ``element`` (a DDL struct); null when it cannot be read."""
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    rows = F.from_json(F.when(body != "", F.concat(F.lit("["), body, F.lit("]"))), f"array<array<{element}>>")
    return F.when(F.size(rows) == 1, F.get(rows, F.lit(0)))


def safe_json(text: Column, schema: str, default: Column | None = None) -> Column:
    """JSON column that falls back to ``default`` (null unless given) on bad input."""
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.coalesce(value, default) if default is not None else value


def _section(text: Column, tag: str) -> Column:
    found = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(rf"(?s)<{tag}>(.*?)</{tag}>"), trim_space(found))


def _pipe_lines(block: Column) -> Column:
    lines = F.filter(
        F.coalesce(F.split(block, "\n"), F.array().cast("array<string>")),
        lambda line: line.contains("|"),
    )
    rows = F.transform(
        lines, lambda line: F.transform(F.split(line, r"\|"), lambda part: trim_space(part))
    )
    return F.filter(
        rows,
        lambda p: (F.size(p) >= 3) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != "")
        & (F.get(p, F.lit(2)) != ""),
    )


def memories_text(text: Column) -> Column:
    """The memories section, or the reply without the two graph sections."""
    rest = F.regexp_replace(text, r"(?s)<entities>.*?</entities>", "")
    rest = F.regexp_replace(rest, r"(?s)<relationships>.*?</relationships>", "")
    return F.coalesce(_section(text, "memories"), trim_space(rest))


def memory_lines(text: Column) -> Column:
    """Array of ``struct(line, event_date)`` for the non-blank memory lines."""
    lines = F.filter(F.split(memories_text(text), "\n"), lambda s: trim_space(s) != "")

    def dated(line: Column) -> Column:
        day = F.regexp_extract(line, r"^\[(\d{4}-\d{2}-\d{2})\]", 1)
        return F.struct(line.alias("line"), F.when(day != "", day).alias("event_date"))

    return F.transform(lines, dated)


def entity_lines(text: Column) -> Column:
    """Array of ``struct(name, type, summary)``; extra separators stay in the summary."""
    return F.transform(
        _pipe_lines(_section(text, "entities")),
        lambda p: F.struct(
            F.get(p, F.lit(0)).alias("name"),
            F.get(p, F.lit(1)).alias("type"),
            F.array_join(F.slice(p, F.lit(3), F.size(p)), "|").alias("summary"),
        ),
    )


def relationship_lines(text: Column) -> Column:
    """Array of ``struct(source, relation, target, date)``; an empty fourth part is null."""
    return F.transform(
        _pipe_lines(_section(text, "relationships")),
        lambda p: F.struct(
            F.get(p, F.lit(0)).alias("source"),
            F.get(p, F.lit(1)).alias("relation"),
            F.get(p, F.lit(2)).alias("target"),
            F.when(F.get(p, F.lit(3)) != "", F.get(p, F.lit(3))).alias("date"),
        ),
    )


def _replace_first(text: Column, mark: str, value: Column) -> Column:
    at = F.locate(mark, text)
    return F.when(
        at > 0,
        F.concat(F.substring(text, F.lit(1), at - 1), value,
                 F.substring(text, at + len(mark), F.length(text))),
    ).otherwise(text)


def fill_template(template: Column, question: Column, question_date: Column, context: Column) -> Column:
    """Fill the first mark of each kind; a missing date reads ``Not specified``."""
    out = _replace_first(template, "{{question}}", question)
    out = _replace_first(
        out, "{{questionDate}}", F.coalesce(F.when(question_date != "", question_date), F.lit("Not specified"))
    )
    return _replace_first(out, "{{context}}", context)
