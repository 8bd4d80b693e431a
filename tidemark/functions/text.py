"""Tokens, chunk splitting, hashing and other text columns, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop list used by keyword ranking.
STOP_WORDS = tuple(
    """
    a an the is are was were be been being have has had do does did will would could should may
    might shall can to of in for on with at by from as into through during before after above below
    between out off over under again then once here there when where why how all each every both few
    more most other some such no nor not only own same so than too very just because but and or if
    while about up i me my we our you your he him his she her it its they them their what which who
    whom this that these those am
    """.split()
)

# The two patterns that mark a counting or listing question.
COUNTING_PATTERNS = (
    r"\b(how many|how much|list all|what are all|count|total|every|each of)\b",
    r"\b(all the|all my|everything)\b",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (higher-order functions do no CSE)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_space(text: Column) -> Column:
    """Strip spaces, tabs and line breaks at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def plain_tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric tokens longer than one character, duplicates kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def bm25_tokens(text: Column) -> Column:
    """``plain_tokens`` without the stop list."""
    return F.filter(
        F.split(F.lower(text), "[^a-z0-9]+"),
        lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS),
    )


def name_keys(name: Column) -> Column:
    """Index keys of an entity name: the full name and each part longer than two characters."""
    clean = trim_space(name)
    parts = F.filter(F.split(clean, r"\s+"), lambda p: F.length(p) > 2)
    return F.array_distinct(
        F.transform(F.concat(F.array(clean), parts), lambda p: F.lower(p))
    )


def term_runs(tokens: Column) -> Column:
    """Array of (term, tf, dl): each token once, its uses, and the number of all tokens.

    Sorted tokens stand in runs; a run's length is the distance to the next run's start.
    """
    def runs(s: Column) -> Column:
        new = F.when(F.size(s) > 0, F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return let(new, lambda starts: F.transform(starts, lambda at, k: F.struct(
            F.get(s, at).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(s)) - at).cast("bigint").alias("tf"),
            F.size(s).alias("dl"))))

    return let(F.sort_array(tokens), runs)


def word_sequence(text: Column) -> Column:
    """Lower-case runs of ``[a-z0-9_]``: the units between ASCII word boundaries."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: F.length(t) > 0)


def graph_key(name: Column) -> Column:
    """Graph node key: lower case, spaces to underscores."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def content_hash(text: Column) -> Column:
    """md5 of the trimmed lower-case text."""
    return F.md5(F.lower(trim_space(text)))


def date_from_filename(name: Column) -> Column:
    """Leading ``yyyy-MM-dd`` of a file name, else null."""
    found = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def is_counting_query(text: Column) -> Column:
    """True where the question asks for a count or a full listing."""
    low = F.lower(text)
    return low.rlike(COUNTING_PATTERNS[0]) | low.rlike(COUNTING_PATTERNS[1])


def clean_subquery_lines(text: Column) -> Column:
    """Model output lines without list marks, 4 to 199 characters long, the first five."""
    lines = F.transform(
        F.split(trim_space(text), "\n"),
        lambda line: trim_space(F.regexp_replace(line, r"^[-*\d.)\s]+", "")),
    )
    return F.slice(F.filter(lines, lambda s: (F.length(s) > 3) & (F.length(s) < 200)), 1, 5)


def rerank_line(pos: Column, date: Column, content: Column) -> Column:
    """Candidate line ``[i] [date] content`` with the content cut at 400 characters."""
    dated = F.coalesce(F.concat(F.lit(" ["), F.when(date != "", date), F.lit("]")), F.lit(""))
    return F.concat(F.lit("["), pos.cast("string"), F.lit("]"), dated, F.lit(" "),
                    F.substring(content, 1, 400))


def repo_container(name: Column) -> Column:
    """Container of a repository: ``repo-`` and a dash-only slug."""
    return F.concat(F.lit("repo-"), F.regexp_replace(F.lower(name), "[^a-z0-9-]", "-"))


def question_container(question_id: Column, run: Column) -> Column:
    """Container of one question in one data source run: ``{question}-{run}``."""
    return F.concat(question_id.cast("string"), F.lit("-"), run.cast("string"))


def safe_id(name: Column) -> Column:
    """Replace everything outside ``[A-Za-z0-9_-]`` by an underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def valid_container(name: Column) -> Column:
    """Container names may hold letters, digits, underscore and dash only."""
    return F.coalesce(name.rlike("^[a-zA-Z0-9_-]+$"), F.lit(False))


# --- chunk splitting -------------------------------------------------------------------------

# Texts are read through slices of this many characters, so that a step near the end of a very
# long text does not scan the text from its beginning.
_SLAB = 65536


def _last_index(window: Column, mark: str) -> Column:
    """0-based position of the last ``mark`` in ``window``; negative when absent."""
    hit = F.locate(mark[::-1], F.reverse(window))
    return F.when(hit > 0, F.length(window) - len(mark) - hit + 1).otherwise(F.lit(-1))


def _slabs(text: Column, reach: int) -> Column:
    count = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / _SLAB).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count),
        lambda i: F.substring(text, i * _SLAB + 1, F.lit(_SLAB + reach)),
    )


def _window(slabs: Column, start: Column, width: int) -> Column:
    slab = F.element_at(slabs, (F.floor(start / _SLAB) + 1).cast("int"))
    return F.substring(slab, F.pmod(start, F.lit(_SLAB)).cast("int") + 1, F.lit(width))


def _run_splitter(text: Column, size: int, cut: Callable[[Column], Column], overlap: int,
                  skip_space: bool, trim: bool, expected_step: int) -> Column:
    """Fold over the text; ``cut(window)`` gives the number of characters the next chunk takes.

    The window holds ``size + 2`` characters from the current start. A second fold, empty for
    ordinary rows, finishes texts whose steps are shorter than expected.
    """
    reach = size + 2

    def folded(txt: Column) -> Column:
        length = F.length(F.regexp_replace(txt, r"\s+$", "")) if skip_space else F.length(txt)

        def with_parts(slabs: Column, total: Column) -> Column:
            empty = F.array().cast("array<string>")
            zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), empty.alias("parts"))

            def step(state: Column, _: Column) -> Column:
                at = state["at"]

                def advance(window: Column) -> Column:
                    # The first step still sees the blanks at the end of the text.
                    rest = F.when(at == 0, F.length(txt)).otherwise(total - at) if skip_space else total - at
                    whole = rest <= size

                    def emit(taken: Column) -> Column:
                        piece = F.substring(window, F.lit(1), taken)
                        piece = trim_space(piece) if trim else piece
                        jump = F.greatest(at + taken - overlap, F.lit(0))
                        if skip_space:
                            gap = F.length(window) - F.length(
                                F.regexp_replace(F.substring(window, taken + 1, F.lit(reach)), r"^\s+", "")
                            ) - taken
                            jump = jump + gap
                        return F.struct(
                            jump.cast("int").alias("at"),
                            (whole | (jump >= total)).alias("done"),
                            F.concat(state["parts"], F.array(piece)).alias("parts"),
                        )

                    return let(F.when(whole, rest).otherwise(cut(window)).cast("int"), emit)

                return F.when(state["done"], state).otherwise(
                    let(_window(slabs, at, reach), advance)
                )

            usual = F.sequence(F.lit(1), (F.ceil(total / expected_step) + 2).cast("int"))
            once = F.aggregate(usual, zero, step)

            def finish(state: Column) -> Column:
                extra = F.when(state["done"], F.array().cast("array<int>")).otherwise(
                    F.sequence(F.lit(1), total + 1)
                )
                return F.aggregate(extra, state, step)["parts"]

            return let(once, finish)

        return let(length.cast("int"), lambda n: let(_slabs(txt, reach), lambda s: with_parts(s, n)))

    return folded(text)


def sentence_chunks(text: Column, size: int = 1600, overlap: int = 320) -> Column:
    """Overlapping chunks cut after the last sentence end, line break or space in the window.

    Sentence ends and line breaks count only past half of the window. A break that would not move
    the start forward is replaced by a hard cut, so every text terminates.
    """

    def cut(window: Column) -> Column:
        sentence = _last_index(window, ". ")
        line = _last_index(F.substring(window, 1, size + 1), "\n")
        space = _last_index(F.substring(window, 1, size + 1), " ")

        def choose(at: Column, otherwise: Column, least: float) -> Column:
            return let(at, lambda p: F.when((p > 0) & (p >= least), p).otherwise(otherwise))

        picked = choose(sentence, choose(line, choose(space, F.lit(size), 0), size * 0.5), size * 0.5)
        return let(picked, lambda p: F.when(p + 1 - overlap <= 0, size + 1).otherwise(p + 1))

    parts = _run_splitter(text, size, cut, overlap, False, True, max(1, size // 2 - overlap))
    return F.when(F.length(text) <= size, F.array(trim_space(text))).otherwise(
        F.filter(parts, lambda p: F.length(p) > 0)
    )


def message_chunks(text: Column, size: int = 9500) -> Column:
    """Chunks without overlap; fill marks 50, 50 and 30 percent; the remainder is trimmed."""

    def cut(window: Column) -> Column:
        sentence = _last_index(window, ". ")
        line = _last_index(F.substring(window, 1, size + 1), "\n")
        space = _last_index(F.substring(window, 1, size + 1), " ")

        def choose(at: Column, otherwise: Column, least: float) -> Column:
            return let(at, lambda p: F.when(p >= least, p).otherwise(otherwise))

        picked = choose(
            sentence, choose(line, choose(space, F.lit(size), size * 0.3), size * 0.5), size * 0.5
        )
        return picked + 1

    parts = _run_splitter(text, size, cut, 0, True, True, max(1, int(size * 0.3)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.filter(parts, lambda p: F.length(p) > 0)
    )


def line_chunks(text: Column, size: int = 6000, fill: float = 0.4) -> Column:
    """Chunks cut after the last line break past ``fill`` of the window, else hard; not trimmed."""

    def cut(window: Column) -> Column:
        line = _last_index(F.substring(window, 1, size + 1), "\n")
        return let(line, lambda p: F.when(p > size * fill, p + 1).otherwise(F.lit(size)))

    parts = _run_splitter(text, size, cut, 0, False, False, max(1, int(size * fill)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(parts)


SPLITTERS = {"sentence": sentence_chunks, "message": message_chunks, "line": line_chunks}


def chunk_rows(df: DataFrame, text_col: str, splitter: str = "sentence",
               keep: Sequence[str] | None = None, **options) -> DataFrame:
    """One row per chunk with ``chunk_index`` (BIGINT, from 0) and ``content``."""
    keep = list(keep) if keep is not None else [c for c in df.columns if c != text_col]
    parts = SPLITTERS[splitter](F.col(text_col), **options)
    return df.select(*keep, F.posexplode(parts).alias("chunk_index", "content")).withColumn(
        "chunk_index", F.col("chunk_index").cast("bigint")
    )
