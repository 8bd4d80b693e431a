"""Text, chunk, parsing and context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import parsing as ps
from ..functions import text as tx
from ..operators import context as cx
from ..operators import index as ix
from ..operators import infer as nf
from ..operators import migrate as mg
from ..operators import search as se
from ..plans.skew import first_row, spread_few_files
from ..sources.datasets import category_type, role_of_name
from .base import Tables, query
from .shapes import PHASE_CTES, bm25_ctes, corpus, items, phase_log


def _last(window: str, mark: str, n: int = 1) -> str:
    """SQL: 0-based last position of a mark of ``n`` characters, -1 if absent."""
    hit = f"strpos(reverse({window}), {mark})"
    return f"(CASE WHEN {hit} > 0 THEN length({window}) - {n} - {hit} + 1 ELSE -1 END)"


def _documents(t: Tables) -> DataFrame:
    return spread_few_files(t("documents").select("doc_id", "text"), "doc_id")


def _messages(t: Tables) -> DataFrame:
    return t("conversations").select(F.lit("talk").alias("container"), F.col("conv_id").alias("session_id"), "turn",
                                     role_of_name(F.col("role")).alias("role"), "text")


_ROLE = "CASE WHEN lower(role) = 'user' THEN 'user' ELSE 'assistant' END"
_TALK = f"""SELECT 'talk' AS container, conv_id AS session_id, 
string_agg({_ROLE} || ': ' || text, chr(10) ORDER BY turn, {_ROLE} || ': ' || text) AS content FROM conversations GROUP BY conv_id"""


@query("session_transcripts", _TALK)
def session_transcripts(t: Tables) -> DataFrame:
    return ix.transcripts(_messages(t))


@query("speaker_transcripts", """SELECT conv_id AS session_id, string_agg(CASE WHEN role <> 'system' THEN 'S-' || role
ELSE role END || CASE WHEN turn % 2 = 0 THEN ' [t' || turn || ']' ELSE '' END || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id""")
def speaker_transcripts(t: Tables) -> DataFrame:
    rows = t("conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text",
        F.when(F.col("role") != "system", F.concat(F.lit("S-"), F.col("role"))).alias("speaker"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("timestamp"))
    return cx.speaker_transcript(rows)


@query("json_transcripts", """SELECT session_id, 'Here is the date the following session took place: d' || session_id
|| chr(10) || chr(10) || 'Here is the session as a stringified JSON:' || chr(10)
|| replace(replace('[' || string_agg(to_json({'role': role, 'content': text})::VARCHAR, ',' ORDER BY turn) || ']', '<', '&lt;'), '>', '&gt;')
AS transcript FROM (SELECT conv_id AS session_id, * FROM conversations) GROUP BY session_id""")
def json_transcripts(t: Tables) -> DataFrame:
    rows = t("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text",
                                     F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("date"))
    return cx.json_transcript(rows, date="date")


def _sentence_sql(rows: str, size: int = 1600, overlap: int = 320) -> str:
    """Recursive SQL for the sentence splitter over ``rows(id…, text)`` with id column ``id``."""
    w2 = f"substring(text, p + 1, {size + 2})"
    w1 = f"substring(text, p + 1, {size + 1})"
    s, n, b = _last(w2, "' .'", 2), _last(w1, "chr(10)"), _last(w1, "' '")
    ok = "{0} > 0 AND {0} >= " + str(size * 0.5)
    pick = (f"CASE WHEN {ok.format(s)} THEN {s} WHEN {ok.format(n)} THEN {n} WHEN {b} > 0 THEN {b} ELSE {size} END")
    guard = f"CASE WHEN ({pick}) + 1 - {overlap} <= 0 THEN {size + 1} ELSE ({pick}) + 1 END"
    return f"""RECURSIVE src AS ({rows}),
c AS (SELECT id, text, 0::BIGINT AS p, 0::BIGINT AS took, 0 AS step, false AS done FROM src WHERE length(text) > {size}
  UNION ALL
  SELECT id, text, p2, took2, step + 1, fin FROM (
    SELECT id, text, step, p AS p0, CASE WHEN length(text) - p <= {size} THEN length(text) - p ELSE {guard} END AS took2,
      p AS p2, length(text) - p <= {size} AS fin FROM (
        SELECT id, text, step, CASE WHEN step = 0 THEN 0 ELSE p + took - {overlap} END AS p FROM c WHERE NOT done) x) y),
parts AS (SELECT id, step, regexp_replace(substring(text, p + 1, took), '^\\s+|\\s+$', '', 'g') AS content FROM c WHERE step > 0
  UNION ALL SELECT id, 1, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM src WHERE length(text) <= {size}),
kept AS (SELECT parts.id, parts.step, content FROM parts JOIN src USING (id) WHERE content <> '' OR length(text) <= {size})"""


_NUMBERED = "CAST(row_number() OVER (PARTITION BY id ORDER BY step) - 1 AS BIGINT) AS chunk_index, content FROM kept"


@query("sentence_chunks", f"WITH {_sentence_sql('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, {_NUMBERED}")
def sentence_chunks(t: Tables) -> DataFrame:
    return tx.chunk_rows(_documents(t), "text", "sentence")


@query("sentence_chunks_small", f"WITH {_sentence_sql('SELECT doc_id AS id, text FROM documents', 200, 40)} SELECT id AS doc_id, {_NUMBERED}")
def sentence_chunks_small(t: Tables) -> DataFrame:
    return tx.chunk_rows(_documents(t), "text", "sentence", size=200, overlap=40)


@query("conversation_chunks", f"""WITH {_sentence_sql("SELECT session_id AS id, content AS text FROM (" + _TALK + ")")}
SELECT 'talk' AS container, id AS session_id, 'talk_' || id || '_' || (row_number() OVER (PARTITION BY id ORDER BY step) - 1) AS chunk_id,
{_NUMBERED}""")
def conversation_chunks(t: Tables) -> DataFrame:
    return ix.build_index(_messages(t)).chunks


def _line_sql(size: int, fill: float) -> str:
    n = _last(f"substring(text, p + 1, {size + 1})", "chr(10)")
    return f"""WITH RECURSIVE c AS (SELECT doc_id, text, 0::BIGINT AS p, 0::BIGINT AS took, 0 AS step FROM documents
  WHERE length(text) > {size} UNION ALL
  SELECT doc_id, text, p, CASE WHEN length(text) - p <= {size} THEN length(text) - p
    WHEN {n} > {size * fill} THEN {n} + 1 ELSE {size} END, step + 1
  FROM (SELECT doc_id, text, p + took AS p, step FROM c) x WHERE p < length(text)),
parts AS (SELECT doc_id, step, substring(text, p + 1, took) AS content FROM c WHERE step > 0
  UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) <= {size})"""


@query("line_chunks", _line_sql(6000, 0.4) + """ SELECT doc_id, CAST(step - 1 AS BIGINT) AS chunk_index, content,
CASE WHEN count(*) OVER (PARTITION BY doc_id) = 1 THEN doc_id::VARCHAR ELSE doc_id || '_c' || (step - 1) END AS sid FROM parts""")
def line_chunks(t: Tables) -> DataFrame:
    parts = tx.line_chunks(F.col("text"))
    rows = _documents(t).select("doc_id", F.size(parts).alias("n_chunks"), F.posexplode(parts).alias("i", "content"))
    rows = rows.withColumn("chunk_index", F.col("i").cast("bigint")).drop("i")
    return mg.chunk_ids(rows, "doc_id").drop("n_chunks")


@query("line_chunks_small", _line_sql(300, 0.5) + " SELECT doc_id, CAST(step - 1 AS BIGINT) AS chunk_index, content FROM parts")
def line_chunks_small(t: Tables) -> DataFrame:
    return tx.chunk_rows(_documents(t), "text", "line", size=300, fill=0.5)


def _message_sql(size: int) -> str:
    w2, w1 = f"substring(rem, 1, {size + 2})", f"substring(rem, 1, {size + 1})"
    s, n, b = _last(w2, "' .'", 2), _last(w1, "chr(10)"), _last(w1, "' '")
    pick = f"CASE WHEN {s} >= {size * .5} THEN {s} WHEN {n} >= {size * .5} THEN {n} WHEN {b} >= {size * .3} THEN {b} ELSE {size} END"
    trim = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
    return f"""WITH RECURSIVE c AS (SELECT doc_id, text AS rem, '' AS content, 0 AS step FROM documents WHERE length(text) > {size}
  UNION ALL
  SELECT doc_id, CASE WHEN length(rem) <= {size} THEN '' ELSE {trim.format(f'substring(rem, ({pick}) + 2)')} END,
    CASE WHEN length(rem) <= {size} THEN rem ELSE {trim.format(f'substring(rem, 1, ({pick}) + 1)')} END, step + 1
  FROM c WHERE length(rem) > 0),
parts AS (SELECT doc_id, step, content FROM c WHERE step > 0 UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) <= {size})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS BIGINT) AS chunk_index, content FROM parts"""


@query("message_chunks", _message_sql(9500))
def message_chunks(t: Tables) -> DataFrame:
    return tx.chunk_rows(_documents(t), "text", "message")


@query("message_chunks_small", _message_sql(400))
def message_chunks_small(t: Tables) -> DataFrame:
    return tx.chunk_rows(_documents(t), "text", "message", size=400)


_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("chunk_dedup", """SELECT doc_id, source, text FROM documents
QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1""")
def chunk_dedup(t: Tables) -> DataFrame:
    return first_row(t("documents").select("doc_id", "source", "text"), ["source", "text"], [F.col("doc_id")])


@query("source_union_dedup", f"""WITH u AS (SELECT 0 AS priority, doc_id AS id, text FROM documents WHERE lang = 'fr'
  UNION ALL SELECT 1, doc_id, text FROM documents UNION ALL SELECT 2, conv_id * 100 + turn, text FROM conversations
  UNION ALL SELECT 3, item_id, text FROM benchmark)
SELECT priority, id, md5(lower({_TRIM.format('text')})) AS content_hash FROM u WHERE {_TRIM.format('text')} <> ''
QUALIFY row_number() OVER (PARTITION BY md5(lower({_TRIM.format('text')})) ORDER BY priority, id) = 1""")
def source_union_dedup(t: Tables) -> DataFrame:
    docs = t("documents").select(F.col("doc_id").alias("id"), "text", "lang")
    sources = [
        (0, docs.where("lang = 'fr'").drop("lang")),
        (1, docs.drop("lang")),
        (2, t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")),
        (3, t("benchmark").select(F.col("item_id").alias("id"), "text")),
    ]
    sources = [(p, mg.drop_blank(df, "text")) for p, df in sources]
    return mg.union_dedup(sources, "text", ["id"]).select("priority", "id", "content_hash")


@query("slash_dates", """WITH o AS (SELECT event_id, ts, event_id % 50 = 7 AS bad FROM events)
SELECT event_id, CASE WHEN NOT bad THEN strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:00.000Z') END AS iso,
CASE WHEN NOT bad THEN (CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END) || ':' || strftime(ts, '%M') || ' '
|| CASE WHEN hour(ts) >= 12 THEN 'pm' ELSE 'am' END || ' on ' || day(ts) || ' ' || strftime(ts, '%B') || ', ' || year(ts) END AS formatted
FROM o""")
def slash_dates(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 50 == 7, "sometime soon").otherwise(F.date_format("ts", "yyyy/MM/dd (EEE) HH:mm"))
    parsed = dt.parse_slash_date(text)
    return t("events").select("event_id", parsed["iso"].alias("iso"), parsed["formatted"].alias("formatted"))


@query("clock_dates", """SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:00.000Z') END AS iso,
CASE WHEN event_id % 50 <> 7 THEN (CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END) || ':' || strftime(ts, '%M') || ' '
|| CASE WHEN hour(ts) >= 12 THEN 'pm' ELSE 'am' END || ' on ' || day(ts) || ' ' || strftime(ts, '%b') || ', ' || year(ts) END AS formatted
FROM events""")
def clock_dates(t: Tables) -> DataFrame:
    text = F.concat(F.date_format("ts", "h:mm"), F.lit(" "), F.upper(F.date_format("ts", "a")), F.lit(" on "),
                    F.date_format("ts", "d"), F.lit(" "),
                    F.when(F.col("event_id") % 50 == 7, "Foo").otherwise(F.date_format("ts", "MMM")), F.lit(", "),
                    F.date_format("ts", "yyyy"))
    parsed = dt.parse_clock_date(text)
    return t("events").select("event_id", parsed["iso"].alias("iso"), parsed["formatted"].alias("formatted"))


@query("date_texts", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'unknown' AS none,
CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS from_name FROM orders""")
def date_texts(t: Tables) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("note-"), iso)).otherwise(F.concat(iso, F.lit(".md")))
    return t("orders").select("o_orderkey", dt.date_of(iso).alias("day"), dt.date_of(F.lit(None).cast("string")).alias("none"),
                              tx.date_from_filename(name).alias("from_name"))


# Replies in the forms a judge gives, chosen by value and event type.
def _reply():
    v = F.round("value").cast("bigint").cast("string")
    return (
        F.when(F.col("event_type") == "view", F.concat(F.lit('Sure:\n```json\n{"score": 1, "label": "correct", "explanation": "v'), v, F.lit('"}\n```')))
        .when(F.col("event_type") == "click", F.lit('{"score": "1", "label": "correct"}'))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"score": 0.'), v, F.lit(', "label": "maybe", "explanation": null}')))
        .when(F.col("value") > 50, F.lit('it is "CORRECT" {broken'))
        .when(F.col("event_type") == "signup", F.lit('"correct" not "incorrect" {oops}'))
        .otherwise(F.lit("no verdict"))
    )


@query("verdict_parse", """SELECT event_id, CASE WHEN event_type = 'view' OR (event_type NOT IN ('view', 'click', 'purchase') AND value > 50) THEN 1 ELSE 0 END AS score,
CASE WHEN event_type IN ('view', 'click') OR (event_type <> 'purchase' AND value > 50) THEN 'correct' ELSE 'incorrect' END AS label,
CASE WHEN event_type = 'view' THEN 'v' || CAST(round(value) AS BIGINT) WHEN event_type IN ('click', 'purchase') THEN ''
ELSE 'Failed to parse judge response' END AS explanation FROM events""")
def verdict_parse(t: Tables) -> DataFrame:
    return t("events").select("event_id", ps.parse_verdict(_reply()).alias("_v")).select("event_id", "_v.*")


@query("json_array_parse", """SELECT event_id, 'result_1' AS result_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS relevant FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'result_2', 1 FROM events WHERE event_type <> 'error'""")
def json_array_parse(t: Tables) -> DataFrame:
    first = F.when(F.col("value") > 20, "1").otherwise("2")
    reply = F.when(F.col("event_type") == "error", "none of [them").otherwise(F.concat(
        F.lit('Labels: [{"id":"result_1","relevant":'), first, F.lit('},{"id":"result_2","relevant":1}] done')))
    rows = t("events").select("event_id", reply.alias("reply"))
    return nf.relevance_labels(rows, "event_id")


def _extraction(t: Tables) -> DataFrame:
    """An extraction reply per order; urgent orders lack the memories tag."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    memories = F.concat(F.lit("["), day, F.lit("] order "), key, F.lit("\n\nundated by "), cust)
    body = F.when(F.col("o_orderpriority") == "1-URGENT", memories).otherwise(
        F.concat(F.lit("<memories>\n"), memories, F.lit("\n</memories>")))
    entities = F.concat(F.lit("\n<entities>\ncustomer "), cust, F.lit("|person|buys|a lot\nbroken|line\n| x | y\norder "), key,
                        F.lit(" | object | paid\n</entities>\n<relationships>\ncustomer "), cust, F.lit("|placed|order "), key,
                        F.lit("|"), F.when(F.col("o_orderstatus") == "F", day).otherwise(""), F.lit("\na|b\n</relationships>"))
    return t("orders").select("o_orderkey", F.concat(body, entities).alias("reply"))


@query("extraction_memories", """SELECT o_orderkey, unnest([0, 1]) AS i,
unnest(['[' || strftime(o_orderdate, '%Y-%m-%d') || '] order ' || o_orderkey, 'undated by ' || o_custkey]) AS line,
unnest([strftime(o_orderdate, '%Y-%m-%d'), NULL]) AS event_date FROM orders""")
def extraction_memories(t: Tables) -> DataFrame:
    return _extraction(t).select("o_orderkey", F.posexplode(ps.memory_lines(F.col("reply"))).alias("i", "_m")).select(
        "o_orderkey", "i", "_m.line", "_m.event_date")


@query("extraction_entities", """SELECT o_orderkey, 'customer ' || o_custkey AS name, 'person' AS type, 'buys|a lot' AS summary FROM orders
UNION ALL SELECT o_orderkey, 'order ' || o_orderkey, 'object', 'paid' FROM orders""")
def extraction_entities(t: Tables) -> DataFrame:
    return _extraction(t).select("o_orderkey", F.explode(ps.entity_lines(F.col("reply"))).alias("_e")).select("o_orderkey", "_e.*")


@query("extraction_relationships", """SELECT o_orderkey, 'customer ' || o_custkey AS source, 'placed' AS relation, 'order ' || o_orderkey AS target,
CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""")
def extraction_relationships(t: Tables) -> DataFrame:
    return _extraction(t).select("o_orderkey", F.explode(ps.relationship_lines(F.col("reply"))).alias("_r")).select("o_orderkey", "_r.*")


@query("judge_rubrics", """SELECT event_id, CASE event_type WHEN 'view' THEN 'abstention' WHEN 'click' THEN 'temporal' WHEN 'purchase' THEN 'update'
WHEN 'signup' THEN 'preference' ELSE 'default' END AS rubric,
CASE WHEN event_type = 'signup' THEN 'Rubric' ELSE 'Ground Truth Answer' END AS truth_label FROM events""")
def judge_rubrics(t: Tables) -> DataFrame:
    kind = F.lit("single-hop")
    for event, name in {"view": "Temporal-ADVERSARIAL", "click": "temporal-update", "purchase": "changing-facts",
                        "signup": "single-Preference"}.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return t("events").select("event_id", ps.judge_rubric(kind).alias("rubric"), ps.truth_label(kind).alias("truth_label"))


@query("counting_queries", r"""WITH x AS (SELECT doc_id, 'd' AS kind, lower(text) AS t FROM documents UNION ALL
SELECT o_orderkey, 'o', CASE WHEN o_orderstatus = 'F' THEN 'how many orders' WHEN o_orderpriority = '2-HIGH' THEN 'everything counts' ELSE 'accounted' END FROM orders)
SELECT doc_id, kind, regexp_matches(t, '\b(how many|how much|list all|what are all|count|total|every|each of)\b')
OR regexp_matches(t, '\b(all the|all my|everything)\b') AS counting FROM x""")
def counting_queries(t: Tables) -> DataFrame:
    made = F.when(F.col("o_orderstatus") == "F", "How many orders").when(F.col("o_orderpriority") == "2-HIGH", "Everything counts").otherwise("accounted")
    rows = t("documents").select("doc_id", F.lit("d").alias("kind"), "text").unionByName(
        t("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("o").alias("kind"), made.alias("text")))
    return rows.select("doc_id", "kind", tx.is_counting_query(F.col("text")).alias("counting"))


@query("subquery_lines", r"""SELECT doc_id, unnest(range(1, len(l) + 1)) - 1 AS i, unnest(l) AS line FROM (SELECT doc_id,
list_slice(list_filter(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)),
  lambda l: regexp_replace(regexp_replace(l, '^[-*\d.)\s]+', ''), '^\s+|\s+$', '', 'g')), lambda l: length(l) > 3 AND length(l) < 200), 1, 5) AS l FROM documents)""")
def subquery_lines(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(tx.clean_subquery_lines(F.col("text"))).alias("i", "line")).withColumn(
        "i", F.col("i").cast("bigint"))


@query("slugs", """SELECT page_id, 'repo-' || regexp_replace(lower(url), '[^a-z0-9-]', '-', 'g') AS repo,
regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe, regexp_matches(url, '^[a-zA-Z0-9_-]+$') AS raw_valid,
true AS safe_valid, replace(lower(url), ' ', '_') AS node FROM pages""")
def slugs(t: Tables) -> DataFrame:
    url = F.col("url")
    return t("pages").select("page_id", tx.repo_container(url).alias("repo"), tx.safe_id(url).alias("safe"),
                             tx.valid_container(url).alias("raw_valid"), tx.valid_container(tx.safe_id(url)).alias("safe_valid"),
                             tx.graph_key(url).alias("node"))


@query("name_keys", r"""SELECT p_partkey, unnest(list_distinct(list_concat([lower(p_name)],
list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: length(x) > 2)))) AS key FROM part""")
def name_keys(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.explode(tx.name_keys(F.col("p_name"))).alias("key"))


@query("templates", """SELECT p.p_partkey, 'Q: ' || p.p_name || ' (' || CASE WHEN p.p_size % 2 = 0 THEN p.p_type ELSE 'Not specified' END || ') C: '
|| p.p_brand || ' {{question}}' AS prompt FROM part p""")
def templates(t: Tables) -> DataFrame:
    date = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return t("part").select("p_partkey", ps.fill_template(
        F.lit("Q: {{question}} ({{questionDate}}) C: {{context}} {{question}}"), F.col("p_name"), date, F.col("p_brand")).alias("prompt"))


@query("category_types", """SELECT o_orderkey, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'single-hop' WHEN '2' THEN 'multi-hop'
WHEN '3' THEN 'temporal' WHEN '4' THEN 'world-knowledge' ELSE 'adversarial' END AS question_type FROM orders""")
def category_types(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", category_type(F.substring("o_orderpriority", 1, 1).cast("int")).alias("question_type"))


@query("safe_json", """SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events""")
def safe_json(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("oops "), F.col("props"))).otherwise(F.col("props"))
    return t("events").select("event_id", F.coalesce(ps.safe_json(text, "k int")["k"], F.lit(-1)).alias("k"))


# --- contexts ----------------------------------------------------------------------------------

_HITS = f"""{bm25_ctes()},
rk AS (SELECT query_id, container, chunk_id, round(bm25_raw, 6) AS score,
  row_number() OVER (PARTITION BY query_id, container ORDER BY round(bm25_raw, 6) DESC, chunk_id) AS rank FROM raw QUALIFY rank <= 5),
h AS (SELECT rk.query_id, rk.chunk_id, round(rk.score / max(rk.score) OVER (PARTITION BY rk.query_id), 6) AS score, rk.rank, d.text AS content,
  doc.source, doc.lang, l.quality, l.toxic FROM rk JOIN d ON d.chunk_id = rk.chunk_id JOIN documents doc ON doc.doc_id = rk.chunk_id
  LEFT JOIN labels l ON l.doc_id = rk.chunk_id)"""


def _hits(t: Tables) -> DataFrame:
    top = se.bm25_top_k(items(t), ix.index_chunks(corpus(t)), 5)
    docs = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")
    labels = t("labels").select(F.col("doc_id").alias("chunk_id"), "quality", "toxic")
    return top.select("query_id", "chunk_id", F.col("bm25").alias("score"), "rank").join(docs, "chunk_id").join(
        labels, "chunk_id", "left")


@query("context_tagged", f"""WITH {_HITS} SELECT query_id,
coalesce(string_agg(CASE WHEN lang <> 'fr' AND lang <> 'es' THEN '<memory session="' || chunk_id || '" date="' || source || '"'
  || CASE WHEN quality = 1 THEN ' eventDate="' || lang || '"' ELSE '' END || '>' || chr(10) || content || chr(10) || '</memory>' END, chr(10) || chr(10) ORDER BY rank),
  'No relevant memory chunks retrieved.') AS chunks,
concat_ws(chr(10), '<entities>' || chr(10) || string_agg(CASE WHEN lang = 'fr' THEN '- ' || source || ' (' || lang || '): ' || content END, chr(10) ORDER BY rank) || chr(10) || '</entities>',
  '<relationships>' || chr(10) || string_agg(CASE WHEN lang = 'es' THEN '- ' || source || ' -in-> ' || lang || ' [' || source || ']' END, chr(10) ORDER BY rank) || chr(10) || '</relationships>') AS graph_context,
'' AS profile_context FROM h GROUP BY query_id""")
def context_tagged(t: Tables) -> DataFrame:
    rows = _hits(t).select(
        "query_id", "rank", "content", F.col("chunk_id").alias("session_id"), F.col("source").alias("memory_date"),
        F.when(F.col("lang") == "es", F.col("source")).alias("date"),
        F.when(F.col("quality") == 1, F.col("lang")).alias("event_date"), F.col("source").alias("name"), F.col("lang").alias("entity_type"),
        "source", F.lit("in").alias("relation"), F.col("lang").alias("target"),
        F.when(F.col("lang") == "fr", "entity").when(F.col("lang") == "es", "relationship").alias("row_type"))
    return cx.tagged_memories(rows)


@query("context_facts", f"""WITH {_HITS} SELECT query_id,
coalesce(string_agg(CASE WHEN lang <> 'fr' THEN '  - ' || content || ' (event_time: ' || CASE WHEN quality = 1 THEN source ELSE 'unknown' END || ')' END, chr(10) ORDER BY rank), '') AS fact_lines,
coalesce(string_agg(CASE WHEN lang = 'fr' THEN '  - ' || CASE WHEN toxic = 1 THEN source ELSE 'Unknown' END || ': ' || content END, chr(10) ORDER BY rank), '') AS entity_lines
FROM h GROUP BY query_id""")
def context_facts(t: Tables) -> DataFrame:
    rows = _hits(t).select("query_id", "rank", F.col("content").alias("fact"), F.when(F.col("quality") == 1, F.col("source")).alias("valid_at"),
                           F.when(F.col("toxic") == 1, F.col("source")).alias("name"), F.col("content").alias("summary"),
                           F.when(F.col("lang") == "fr", "node").alias("row_type"))
    return cx.facts_and_entities(rows)


@query("context_numbered", f"""WITH {_HITS} SELECT query_id, string_agg('[' || rank || ']' || CASE WHEN quality = 1 THEN ' [Timestamp: ' || source || ']' ELSE '' END
|| ' ' || content, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id""")
def context_numbered(t: Tables) -> DataFrame:
    return cx.numbered_memories(_hits(t).withColumn("date", F.when(F.col("quality") == 1, F.col("source"))))


@query("context_with_chunks", f"""WITH {_HITS},
u AS (SELECT query_id, content, rank AS seq, quality FROM h QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY rank) = 1),
tail AS (SELECT query_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY coalesce(quality, 0), seq) AS t FROM u GROUP BY query_id)
SELECT h.query_id, string_agg('Result ' || rank || ':' || chr(10) || source || CASE WHEN quality = 1 OR toxic = 1 THEN chr(10) || 'Temporal Context: '
 || concat_ws(' | ', CASE WHEN quality = 1 THEN 'documentDate: ' || lang END, CASE WHEN toxic = 1 THEN 'eventDate: ' || source END) ELSE '' END,
 chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '=== DEDUPLICATED CHUNKS ===' || chr(10) || any_value(tail.t) AS context
FROM h JOIN tail USING (query_id) GROUP BY h.query_id""")
def context_with_chunks(t: Tables) -> DataFrame:
    hits = _hits(t)
    rows = hits.select("query_id", "rank", F.col("source").alias("memory"), F.when(F.col("quality") == 1, F.col("lang")).alias("document_date"),
                       F.when(F.col("toxic") == 1, F.col("source")).alias("event_date"))
    chunks = hits.select("query_id", "content", F.coalesce("quality", F.lit(0)).alias("position"), F.col("rank").alias("seq"))
    return cx.memories_with_chunks(rows, chunks)


@query("context_files", f"""WITH {_HITS} SELECT query_id, string_agg('=== Memory File ' || rank || ': ' || chunk_id || ' (relevance: '
|| CAST(floor(score * 100 + 0.5) AS BIGINT) || '%) ===' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id""")
def context_files(t: Tables) -> DataFrame:
    return cx.memory_files(_hits(t).withColumn("session_id", F.col("chunk_id")))


@query("context_json", f"""WITH {_HITS} SELECT query_id, '[' || string_agg(to_json({{'chunk_id': chunk_id, 'source': source}})::VARCHAR, ',' ORDER BY rank) || ']' AS context
FROM h GROUP BY query_id""")
def context_json(t: Tables) -> DataFrame:
    return cx.raw_json(_hits(t), ["chunk_id", "source"])


@query("rerank_lines", f"""WITH {_HITS} SELECT query_id, rank, '[' || (rank - 1) || ']' || CASE WHEN quality = 1 THEN ' [' || source || ']' ELSE '' END || ' '
|| substring(content, 1, 400) AS line FROM h""")
def rerank_lines(t: Tables) -> DataFrame:
    date = F.when(F.col("quality") == 1, F.col("source"))
    return _hits(t).select("query_id", "rank", tx.rerank_line(F.col("rank") - 1, date, F.col("content")).alias("line"))


@query("search_records", f"""WITH {_HITS} SELECT b.item_id AS query_id, CAST(count(h.chunk_id) AS BIGINT) AS n,
coalesce(string_agg(h.chunk_id::VARCHAR, ',' ORDER BY h.rank), '') AS ids FROM benchmark b LEFT JOIN h ON h.query_id = b.item_id GROUP BY b.item_id""")
def search_records(t: Tables) -> DataFrame:
    from ..sources.tables import search_records as records

    packed = records(items(t).select("query_id"), _hits(t).select("query_id", "rank", "chunk_id"), ["chunk_id"])
    return packed.select("query_id", F.size("results").cast("bigint").alias("n"),
                         F.array_join(F.transform("results", lambda r: r["chunk_id"].cast("string")), ",").alias("ids"))


@query("containment_judge", f"""WITH {PHASE_CTES} SELECT run_id, question_id, phase,
CASE WHEN phase = 'answer' AND status = 'failed' THEN 0 WHEN phase = 'search' THEN 1 ELSE 0 END AS verdict FROM pl""")
def containment_judge(t: Tables) -> DataFrame:
    answer = F.when(F.col("phase") == "search", F.concat(F.lit("I think: "), F.upper("run_id"), F.lit("."))).otherwise("no idea")
    return phase_log(t).select("run_id", "question_id", "phase", nf.containment_judge(F.col("run_id"), answer).alias("verdict"))


@query("embed_documents", """WITH k AS (SELECT doc_id, md5(t) AS h FROM (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM documents) WHERE t <> ''),
b AS (SELECT doc_id, CAST('0x' || substring(h, 1, 2) AS INT) % 64 AS i, sum(CASE WHEN CAST('0x' || substring(h, 10, 1) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS v
  FROM k GROUP BY ALL)
SELECT doc_id, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 3) AS v FROM b WHERE v <> 0""")
def embed_documents(t: Tables) -> DataFrame:
    out = nf.embed(_documents(t), "text")
    flat = out.select("doc_id", F.posexplode("embedding").alias("i", "_v")).where(F.col("_v") != 0)
    return flat.select("doc_id", "i", F.round(F.col("_v").cast("double"), 3).alias("v"))
