"""The test tables seen as chunks, queries, phase logs, boards and graphs; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from .base import Tables

# --- documents as chunks, benchmark items as queries ------------------------------------------

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def one_container(key: str, name: str = "src") -> Column:
    """The container that holds all rows; rows without a key are in none.

    A plain literal would be folded away and with it the equi-join on the container.
    """
    return F.when(F.col(key).isNotNull(), name)


def corpus(t: Tables) -> DataFrame:
    """All documents in one container."""
    return t("documents").select(one_container("doc_id").alias("container"), F.col("doc_id").alias("chunk_id"),
                                 F.col("text").alias("content"))


def corpus_by_source(t: Tables) -> DataFrame:
    return t("documents").select(F.col("source").alias("container"), F.col("doc_id").alias("chunk_id"),
                                 F.col("text").alias("content"))


def items(t: Tables) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), one_container("item_id").alias("container"), "text")


def corpus_with_vectors(t: Tables) -> DataFrame:
    """Documents with their vector; a document without one has a null vector and cosine 0."""
    vectors = t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return corpus(t).join(vectors, "chunk_id", "left")


def items_with_vectors(t: Tables) -> DataFrame:
    """Items with their vector; some have none and are found by their words alone."""
    vectors = t("embeddings").select(
        F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 5 != 3, F.col("embedding")).alias("embedding"))
    return items(t).join(vectors, "query_id", "left")


D_CORPUS = "d AS (SELECT 'src' AS container, doc_id AS chunk_id, text FROM documents)"
Q_ITEMS = "q AS (SELECT item_id AS query_id, 'src' AS container, text FROM benchmark)"


def bm25_ctes(d: str = D_CORPUS, q: str = Q_ITEMS) -> str:
    """CTEs ending in ``raw(query_id, container, chunk_id, bm25_raw)``."""
    return f"""{d}, {q},
dt AS (SELECT container, chunk_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM d),
tf AS (SELECT container, chunk_id, term, count(*) AS tf FROM dt
       WHERE length(term) > 1 AND term NOT IN {STOP_SQL} GROUP BY ALL),
dl AS (SELECT d.container, d.chunk_id, coalesce(sum(tf.tf), 0) AS dl FROM d
       LEFT JOIN tf ON tf.container = d.container AND tf.chunk_id = d.chunk_id GROUP BY ALL),
st AS (SELECT container, count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl GROUP BY container),
df AS (SELECT container, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, container, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM q),
qf AS (SELECT query_id, container, term, count(*) AS qtf FROM qt
       WHERE length(term) > 1 AND term NOT IN {STOP_SQL} GROUP BY ALL),
raw AS (SELECT qf.query_id, qf.container, tf.chunk_id,
          sum(qf.qtf * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1)
              * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / st.avgdl))) AS bm25_raw
        FROM qf JOIN tf ON tf.container = qf.container AND tf.term = qf.term
        JOIN df ON df.container = qf.container AND df.term = qf.term
        JOIN dl ON dl.container = tf.container AND dl.chunk_id = tf.chunk_id
        JOIN st ON st.container = qf.container GROUP BY ALL)"""


# --- events as a phase log ---------------------------------------------------------------------

PHASE_OF = {"view": "ingest", "click": "indexing", "purchase": "search", "signup": "answer", "error": "evaluate"}
TYPE_OF = {0: "single-hop", 1: "multi-hop", 2: "temporal", 3: "world-knowledge", 4: "adversarial"}


def phase_log(t: Tables) -> DataFrame:
    """Latest event per (user, key block, type): run, question and phase; value decides the status."""
    k = F.get_json_object("props", "$.k").cast("int")
    phase = F.lit(None).cast("string")
    for event, name in PHASE_OF.items():
        phase = F.when(F.col("event_type") == event, name).otherwise(phase)
    rows = t("events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat(F.lit("q"), F.floor(k / 20).cast("string")).alias("question_id"), phase.alias("phase"),
        F.struct("ts", "event_id", "value").alias("_last"),
    ).groupBy("run_id", "question_id", "phase").agg(F.max("_last").alias("_last"))
    value = F.col("_last.value")
    return rows.select(
        "run_id", "question_id", "phase",
        F.when(value < 2, "failed").when(value < 6, "pending").otherwise("completed").alias("status"),
        F.floor(value * 100).cast("bigint").alias("duration_ms"),
        F.when(value > 60, 1).otherwise(0).alias("score"), F.col("_last.ts").alias("started_at"),
    )


_PHASE_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PHASE_OF.items()) + " END"

PHASE_CTES = f"""pe AS (SELECT 'run-' || user_id AS run_id,
  'q' || (CAST(json_extract_string(props, '$.k') AS INT) // 20) AS question_id, {_PHASE_CASE} AS phase,
  ts, event_id, value FROM events),
pl AS (SELECT run_id, question_id, phase,
  CASE WHEN value < 2 THEN 'failed' WHEN value < 6 THEN 'pending' ELSE 'completed' END AS status,
  CAST(floor(value * 100) AS BIGINT) AS duration_ms, CASE WHEN value > 60 THEN 1 ELSE 0 END AS score, ts AS started_at
  FROM pe QUALIFY row_number() OVER (PARTITION BY run_id, question_id, phase ORDER BY ts DESC, event_id DESC) = 1)"""


def questions(t: Tables) -> DataFrame:
    """Questions that occur in the log, with a type."""
    kind = F.lit(None).cast("string")
    for number, name in TYPE_OF.items():
        kind = F.when(F.col("question_id") == f"q{number}", name).otherwise(kind)
    return phase_log(t).select("question_id").distinct().withColumn("question_type", kind)


QUESTION_CTE = ("qs AS (SELECT DISTINCT question_id, CASE question_id "
                + " ".join(f"WHEN 'q{n}' THEN '{v}'" for n, v in TYPE_OF.items())
                + " END AS question_type FROM pl)")


def runs(t: Tables) -> DataFrame:
    """One run per user; the stored status follows from its first event's value."""
    first = t("events").groupBy("user_id").agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("v"), F.min("ts").alias("created_at"))
    return first.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.when(F.col("v") < 8, "initializing").when(F.col("v") < 20, "running").when(F.col("v") < 30, "completed")
        .when(F.col("v") < 35, "failed").otherwise("initializing").alias("status"),
        F.when(F.col("v") >= 100, "stopping").when(F.col("v") >= 80, "running").alias("active_status"),
        F.concat(F.lit("cmp-"), F.floor(F.col("user_id") / 4).cast("string")).alias("compare_id"),
        "created_at",
    )


RUNS_CTE = """r0 AS (SELECT user_id, arg_min(value, {'ts': ts, 'event_id': event_id}) AS v, min(ts) AS created_at
  FROM events GROUP BY user_id),
runs AS (SELECT 'run-' || user_id AS run_id,
  CASE WHEN v < 8 THEN 'initializing' WHEN v < 20 THEN 'running' WHEN v < 30 THEN 'completed'
       WHEN v < 35 THEN 'failed' ELSE 'initializing' END AS status,
  CASE WHEN v >= 100 THEN 'stopping' WHEN v >= 80 THEN 'running' END AS active_status,
  'cmp-' || (user_id // 4) AS compare_id, created_at FROM r0)"""


# --- customers and orders as a leaderboard -----------------------------------------------------

def board_runs(t: Tables) -> DataFrame:
    return t("customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("provider"),
        F.concat(F.lit("bench-"), F.col("c_nationkey").cast("string")).alias("benchmark"),
        F.when(F.col("c_acctbal") < 2000, " ").when(F.col("c_acctbal") < 6000, "v1").otherwise(" v2 ").alias("version"),
        F.col("c_acctbal").alias("added_at"))


def board_results(t: Tables) -> DataFrame:
    return t("orders").select(
        F.col("o_custkey").alias("run_id"), (F.col("o_orderpriority") != "5-LOW").alias("evaluated"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("score"),
        F.col("o_orderpriority").alias("question_type"))


BOARD_CTES = """br AS (SELECT c_custkey AS run_id, c_mktsegment AS provider, 'bench-' || c_nationkey AS benchmark,
  CASE WHEN c_acctbal < 2000 THEN 'baseline' WHEN c_acctbal < 6000 THEN 'v1' ELSE 'v2' END AS version,
  c_acctbal AS added_at FROM customer),
bs AS (SELECT o_custkey AS run_id, o_orderpriority <> '5-LOW' AS evaluated,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS score, o_orderpriority AS question_type FROM orders),
be AS (SELECT br.*, x.total, x.correct, round(x.correct / x.total, 4) AS accuracy FROM br JOIN (
  SELECT run_id, count(*) AS total, count(*) FILTER (WHERE evaluated) AS ev, count(*) FILTER (WHERE score = 1) AS correct
  FROM bs GROUP BY run_id) x ON x.run_id = br.run_id WHERE x.ev = x.total)"""


# --- nations, regions, customers and suppliers as a graph --------------------------------------

def entities(t: Tables) -> DataFrame:
    def rows(df: DataFrame, name: str, kind: str, summary) -> DataFrame:
        return df.select(F.lit("geo").alias("container"), F.col(name).alias("name"), F.lit(kind).alias("type"),
                         summary.alias("summary"))

    return (
        rows(t("region"), "r_name", "region", F.concat(F.lit("region "), F.col("r_name")))
        .unionByName(rows(t("nation"), "n_name", "nation", F.concat(F.lit("nation "), F.col("n_name"))))
        .unionByName(rows(t("customer"), "c_name", "customer", F.concat(F.lit("buys "), F.col("c_mktsegment"))))
        .unionByName(rows(t("supplier"), "s_name", "supplier", F.lit("supplies parts")))
    )


def edges(t: Tables) -> DataFrame:
    nation = t("nation")
    home = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target"))

    def rows(df: DataFrame, relation: str, order) -> DataFrame:
        return df.select(F.lit("geo").alias("container"), "source", F.lit(relation).alias("relation"), "target",
                         order.cast("bigint").alias("ord")).withColumn(
            "date", F.concat(F.lit("day "), (F.col("ord") % 28).cast("string")))

    to_region = nation.join(t("region"), nation.n_regionkey == F.col("r_regionkey")).select(
        F.col("n_name").alias("source"), F.col("r_name").alias("target"), "n_nationkey")
    buyers = t("customer").select(F.col("c_name").alias("source"), F.col("c_nationkey").alias("k"), "c_custkey")
    sellers = t("supplier").select(F.col("s_name").alias("source"), F.col("s_nationkey").alias("k"), "s_suppkey")
    return (
        rows(to_region, "belongs_to", F.col("n_nationkey"))
        .unionByName(rows(buyers.join(home, "k"), "located_in", F.col("c_custkey") * 2 + 1000))
        .unionByName(rows(sellers.join(home, "k"), "located_in", F.col("s_suppkey") * 2 + 1001))
    )


GRAPH_CTES = """ent AS (SELECT 'geo' AS container, r_name AS name, 'region' AS type, 'region ' || r_name AS summary FROM region
  UNION ALL SELECT 'geo', n_name, 'nation', 'nation ' || n_name FROM nation
  UNION ALL SELECT 'geo', c_name, 'customer', 'buys ' || c_mktsegment FROM customer
  UNION ALL SELECT 'geo', s_name, 'supplier', 'supplies parts' FROM supplier),
edg AS (SELECT n_name AS source, 'belongs_to' AS relation, r_name AS target, n_nationkey::BIGINT AS ord
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, 'located_in', n_name, c_custkey * 2 + 1000 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, 'located_in', n_name, s_suppkey * 2 + 1001 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
