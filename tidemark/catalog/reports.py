"""Metric, report, run and board queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as cp
from ..operators import filters as fl
from ..operators import index as ix
from ..operators import metrics as mt
from ..operators import report as rp
from ..operators import runs as rn
from ..operators import sampling as sm
from ..operators import search as se
from ..plans.scratch import cut_lineage
from .base import Tables, query
from .shapes import (BOARD_CTES, PHASE_CTES, QUESTION_CTE, RUNS_CTE, bm25_ctes, board_results, board_runs, corpus, items,
                     phase_log, questions, runs)

# --- retrieval metrics -------------------------------------------------------------------------

# Every item once more with a text that no document matches: a question without hits.
_ASKED = """q AS (SELECT item_id AS query_id, 'src' AS container, text FROM benchmark
  UNION ALL SELECT item_id + 1000000, 'src', '~' FROM benchmark)"""

_METRICS = f"""{bm25_ctes(q=_ASKED)},
rk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_raw, 6) DESC, chunk_id) AS rank
  FROM raw QUALIFY rank <= 10),
v AS (SELECT rk.query_id, rank, CASE WHEN coalesce(l.quality, 0) = 1 AND coalesce(l.toxic, 0) = 0 THEN 1 ELSE 0 END AS rel
  FROM rk LEFT JOIN labels l ON l.doc_id = rk.chunk_id),
a AS (SELECT q.query_id, count(v.rank) AS k, coalesce(sum(rel), 0) AS r, min(CASE WHEN rel = 1 THEN rank END) AS f,
  coalesce(sum(rel / log2(rank + 1)), 0) AS dcg FROM q LEFT JOIN v ON v.query_id = q.query_id GROUP BY q.query_id),
i AS (SELECT a.query_id, sum(1 / log2(n + 1)) AS idcg FROM a, range(1, 11) t(n) WHERE n <= greatest(1, a.r) GROUP BY a.query_id),
m AS (SELECT a.query_id, CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_k, CASE WHEN k > 0 THEN r / k ELSE 0 END AS p, k, r, f, dcg / idcg AS g
  FROM a JOIN i USING (query_id)),
mm AS (SELECT query_id, hit_at_k, round(p, 6) AS precision_at_k, hit_at_k AS recall_at_k_ref,
  round(CASE WHEN p + hit_at_k > 0 THEN 2 * p * hit_at_k / (p + hit_at_k) ELSE 0 END, 6) AS f1_at_k,
  round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, round(g, 6) AS ndcg, k, CAST(r AS BIGINT) AS relevant_retrieved,
  CAST(greatest(1, r) AS BIGINT) AS total_relevant FROM m)"""


def _metrics(t: Tables) -> DataFrame:
    blank = items(t).withColumns({"query_id": F.col("query_id") + 1000000, "text": F.lit("~")})
    asked = items(t).unionByName(blank)
    # Search results are stored before they are judged.
    hits = cut_lineage(se.bm25_top_k(asked, ix.index_chunks(corpus(t)), 10))
    relevant = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    judged = t("labels").select(F.col("doc_id").alias("chunk_id"), relevant.alias("relevant"))
    labels = hits.select("query_id", "chunk_id").join(judged, "chunk_id")
    # What counts for recall is every relevant document of the question's container, found or not.
    known = judged.where("relevant = 1").join(corpus(t).select("container", "chunk_id"), "chunk_id").groupBy("container").agg(
        F.count("*").alias("n_relevant"))
    truth = asked.select("query_id", "container").join(known, "container").select("query_id", "n_relevant")
    return mt.retrieval_metrics(asked, hits, labels, 10, truth)


@query("retrieval_metrics", f"""WITH {_METRICS} SELECT *, round(relevant_retrieved / (SELECT count(*) FROM labels JOIN documents USING (doc_id)
  WHERE quality = 1 AND toxic = 0), 6) AS recall_at_k FROM mm""")
def retrieval_metrics(t: Tables) -> DataFrame:
    return _metrics(t)


@query("retrieval_means", f"""WITH {_METRICS} SELECT round(avg(hit_at_k), 6) AS hit_at_k, round(avg(precision_at_k), 6) AS precision_at_k,
round(avg(recall_at_k_ref), 6) AS recall_at_k_ref, round(avg(f1_at_k), 6) AS f1_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
arg_max(k, query_id) AS k, count(*) AS n FROM mm""")
def retrieval_means(t: Tables) -> DataFrame:
    return mt.retrieval_means(_metrics(t))


# --- latency and accuracy ----------------------------------------------------------------------

def _latency_sql(rows: str, by: str, value: str) -> str:
    return f"""lr AS ({rows}), ls AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS i,
  count(*) OVER (PARTITION BY {by}) AS n FROM lr WHERE {value} > 0),
lat AS (SELECT {by}, min({value}) AS min, max({value}) AS max, CAST(floor(avg({value}) + 0.5) AS BIGINT) AS mean,
  max(CASE WHEN i = floor(n * 0.5::DOUBLE) THEN {value} END) AS median, max(CASE WHEN i = floor(n * 0.95::DOUBLE) THEN {value} END) AS p95,
  max(CASE WHEN i = floor(n * 0.99::DOUBLE) THEN {value} END) AS p99, CAST(floor(stddev_pop({value}) + 0.5) AS BIGINT) AS std_dev,
  count(*) AS count FROM ls GROUP BY {by})"""


@query("latency_stats", f"""WITH {_latency_sql('SELECT event_type, value FROM events', 'event_type', 'value')} SELECT * FROM lat""")
def latency_stats(t: Tables) -> DataFrame:
    return rp.latency_stats(t("events"), "value", ["event_type"])


@query("latency_stats_prices", f"""WITH {_latency_sql('SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders', 'o_orderstatus, o_orderpriority', 'o_totalprice')} SELECT * FROM lat""")
def latency_stats_prices(t: Tables) -> DataFrame:
    return rp.latency_stats(t("orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"])


@query("accuracy_by_type", """SELECT coalesce(lang, '(all)') AS lang, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS correct,
round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def accuracy_by_type(t: Tables) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id").withColumn("score", F.col("quality"))
    return rp.accuracy_by_type(rows, "lang")


_DONE = "dn AS (SELECT run_id, question_id, score FROM pl WHERE phase = 'evaluate' AND status = 'completed')"


def _report(t: Tables):
    log = phase_log(t)
    results = log.where(F.col("phase") == "evaluate").select("run_id", "question_id", "score")
    return rp.report(questions(t), log, results)


@query("report_summary", f"""WITH {PHASE_CTES}, {_DONE} SELECT run_id, count(*) AS total, count(*) FILTER (WHERE score = 1) AS correct,
round(count(*) FILTER (WHERE score = 1) / count(*), 6) AS accuracy FROM dn GROUP BY run_id""")
def report_summary(t: Tables) -> DataFrame:
    return _report(t)[0]


@query("report_by_type", f"""WITH {PHASE_CTES}, {QUESTION_CTE}, {_DONE} SELECT run_id, question_type, count(*) AS total,
count(*) FILTER (WHERE score = 1) AS correct, round(count(*) FILTER (WHERE score = 1) / count(*), 6) AS accuracy
FROM dn JOIN qs USING (question_id) GROUP BY ALL""")
def report_by_type(t: Tables) -> DataFrame:
    return _report(t)[1]


_USED = """SELECT run_id, phase, duration_ms FROM pl SEMI JOIN dn USING (run_id, question_id)
  UNION ALL SELECT run_id, 'total', sum(coalesce(duration_ms, 0))::BIGINT FROM pl SEMI JOIN dn USING (run_id, question_id) GROUP BY run_id, question_id"""


def _zeros(groups: str, by: str) -> str:
    """All groups with their latency row, zeros where there is none."""
    numbers = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("min", "max", "mean", "median", "p95", "p99", "std_dev", "count"))
    return f"SELECT {by}, {numbers} FROM ({groups}) g LEFT JOIN lat USING ({by})"


@query("report_latency", f"""WITH {PHASE_CTES}, {_DONE}, {_latency_sql(_USED, 'run_id, phase', 'duration_ms')}
{_zeros("SELECT * FROM (SELECT DISTINCT run_id FROM dn), (SELECT unnest(['ingest', 'indexing', 'search', 'answer', 'evaluate', 'total']) AS phase)", "run_id, phase")}""")
def report_latency(t: Tables) -> DataFrame:
    return _report(t)[2]


@query("report_type_latency", f"""WITH {PHASE_CTES}, {QUESTION_CTE}, {_DONE}, us AS (SELECT run_id, question_id, phase, duration_ms FROM pl SEMI JOIN dn USING (run_id, question_id)
  WHERE phase IN ('search', 'answer') UNION ALL SELECT run_id, question_id, 'total', sum(coalesce(duration_ms, 0))::BIGINT FROM pl SEMI JOIN dn USING (run_id, question_id)
  GROUP BY run_id, question_id),
{_latency_sql("SELECT run_id, coalesce(question_type, '') AS question_type, phase, duration_ms FROM us JOIN qs USING (question_id)", 'run_id, question_type, phase', 'duration_ms')}
{_zeros("SELECT * FROM (SELECT DISTINCT run_id, coalesce(question_type, '') AS question_type FROM dn JOIN qs USING (question_id)), (SELECT unnest(['search', 'answer', 'total']) AS phase)", "run_id, question_type, phase")}""")
def report_type_latency(t: Tables) -> DataFrame:
    log = phase_log(t)
    results = log.where(F.col("phase") == "evaluate").select("run_id", "question_id", "score")
    kinds = questions(t).withColumn("question_type", F.coalesce("question_type", F.lit("")))
    return rp.type_latency(rp.evaluated(kinds, log, results))


@query("retrieval_by_type", f"""WITH {_METRICS} SELECT 'type ' || (query_id % 3) AS question_type, round(avg(hit_at_k), 6) AS hit_at_k,
round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k_ref), 6) AS recall_at_k_ref, round(avg(f1_at_k), 6) AS f1_at_k,
round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, arg_max(k, query_id) AS k, count(*) AS n FROM mm GROUP BY 1""")
def retrieval_by_type(t: Tables) -> DataFrame:
    kind = F.concat(F.lit("type "), (F.col("query_id") % 3).cast("string"))
    return mt.retrieval_means(_metrics(t).withColumn("question_type", kind), by=["question_type"])


@query("question_totals", f"""WITH {PHASE_CTES} SELECT run_id, question_id, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms FROM pl GROUP BY ALL""")
def question_totals(t: Tables) -> DataFrame:
    return rp.question_totals(phase_log(t))


# --- runs --------------------------------------------------------------------------------------

@query("phase_funnel", f"""WITH {PHASE_CTES} SELECT run_id, count(*) FILTER (WHERE phase = 'ingest') AS total,
count(*) FILTER (WHERE phase = 'ingest' AND status = 'completed') AS ingested, count(*) FILTER (WHERE phase = 'indexing' AND status = 'completed') AS indexed,
count(*) FILTER (WHERE phase = 'search' AND status = 'completed') AS searched, count(*) FILTER (WHERE phase = 'answer' AND status = 'completed') AS answered,
count(*) FILTER (WHERE phase = 'evaluate' AND status = 'completed') AS evaluated FROM pl GROUP BY run_id""")
def phase_funnel(t: Tables) -> DataFrame:
    return rn.phase_funnel(phase_log(t))


_STATUS = f"""{PHASE_CTES}, {RUNS_CTE},
ft AS (SELECT run_id, bool_or(status = 'failed') AS af, count(*) FILTER (WHERE phase = 'ingest') AS total,
  count(*) FILTER (WHERE phase = 'ingest' AND status = 'completed') AS ingested,
  count(*) FILTER (WHERE phase = 'evaluate' AND status = 'completed') AS evaluated FROM pl GROUP BY run_id),
rs AS (SELECT runs.run_id, runs.compare_id, CASE WHEN active_status IS NOT NULL THEN active_status WHEN status IN ('completed', 'failed') THEN status
  WHEN coalesce(af, false) THEN 'failed' WHEN coalesce(evaluated, 0) = coalesce(total, 0) AND coalesce(total, 0) > 0 THEN 'completed'
  WHEN coalesce(ingested, 0) > 0 OR status = 'running' THEN 'partial' ELSE 'pending' END AS run_status FROM runs LEFT JOIN ft USING (run_id))"""


def _run_status(t: Tables) -> DataFrame:
    rows = runs(t)
    active = rows.where(F.col("active_status").isNotNull()).select("run_id", "active_status")
    return rn.run_status(rows.select("run_id", "status"), phase_log(t), active)


@query("run_status", f"WITH {_STATUS} SELECT run_id, run_status FROM rs")
def run_status(t: Tables) -> DataFrame:
    return _run_status(t)


@query("compare_status", f"""WITH {_STATUS}, cs AS (SELECT compare_id, CASE WHEN max(v) > 90 THEN 'stopping' END AS state
  FROM (SELECT 'cmp-' || (user_id // 4) AS compare_id, v FROM r0) GROUP BY compare_id)
SELECT compare_id, CASE WHEN any_value(state) = 'stopping' THEN 'stopping' WHEN bool_or(run_status = 'running') THEN 'running'
WHEN bool_or(run_status = 'failed') THEN 'failed' WHEN bool_and(run_status = 'completed') THEN 'completed' ELSE 'partial' END AS compare_status
FROM rs JOIN cs USING (compare_id) GROUP BY compare_id""")
def compare_status(t: Tables) -> DataFrame:
    rows = runs(t)
    members = _run_status(t).join(rows.select("run_id", "compare_id"), "run_id")
    first = t("events").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("v"))
    state = first.groupBy(F.concat(F.lit("cmp-"), F.floor(F.col("user_id") / 4).cast("string")).alias("compare_id")).agg(
        F.when(F.max("v") > 90, "stopping").alias("state"))
    return rn.compare_status(members, state)


@query("pending_work", f"""WITH {PHASE_CTES}, tg AS (SELECT DISTINCT run_id, question_id FROM pl)
SELECT 'search' AS phase, * FROM tg ANTI JOIN (SELECT * FROM pl WHERE phase = 'search' AND status = 'completed') d USING (run_id, question_id)
  SEMI JOIN (SELECT * FROM pl WHERE phase = 'indexing' AND status = 'completed') p USING (run_id, question_id)
UNION ALL SELECT 'evaluate', * FROM tg ANTI JOIN (SELECT * FROM pl WHERE phase = 'evaluate' AND status = 'completed') d USING (run_id, question_id)
  SEMI JOIN (SELECT * FROM pl WHERE phase = 'answer' AND status = 'completed') p USING (run_id, question_id)
  SEMI JOIN (SELECT * FROM pl WHERE phase = 'answer' AND duration_ms > 1000) r USING (run_id, question_id)
UNION ALL SELECT 'ingest', * FROM tg ANTI JOIN (SELECT * FROM pl WHERE phase = 'ingest' AND status = 'completed') d USING (run_id, question_id)""")
def pending_work(t: Tables) -> DataFrame:
    log = phase_log(t)
    targets = log.select("run_id", "question_id").distinct()
    ready = log.where((F.col("phase") == "answer") & (F.col("duration_ms") > 1000))
    parts = [("search", None), ("evaluate", ready), ("ingest", None)]
    frames = [rn.pending_work(targets, log, p, r).withColumn("phase", F.lit(p)) for p, r in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("fork_run", f"""WITH {PHASE_CTES} SELECT 'run-new' AS run_id, question_id, phase,
CASE WHEN phase IN ('search', 'answer', 'evaluate') THEN 'pending' ELSE status END AS status,
CASE WHEN phase NOT IN ('search', 'answer', 'evaluate') THEN duration_ms END AS duration_ms,
CASE WHEN phase NOT IN ('search', 'answer', 'evaluate') THEN score END AS score FROM pl WHERE run_id = 'run-8'""")
def fork_run(t: Tables) -> DataFrame:
    rows = runs(t).withColumns({"data_source_run_id": F.lit(None).cast("string"), "judge": F.lit("a")})
    return rn.fork_run(rows, phase_log(t), "run-8", "run-new", "search", judge="b")[1].drop("started_at")


@query("fork_run_head", f"""WITH {RUNS_CTE} SELECT 'run-new' AS run_id, 'run-8' AS data_source_run_id, 'running' AS status, 'b' AS judge
FROM runs WHERE run_id = 'run-8'""")
def fork_run_head(t: Tables) -> DataFrame:
    rows = runs(t).withColumns({"data_source_run_id": F.lit(None).cast("string"), "judge": F.lit("a")})
    return rn.fork_run(rows, phase_log(t), "run-8", "run-new", "search", judge="b")[0].select(
        "run_id", "data_source_run_id", "status", "judge")


@query("indexing_episodes", """WITH e AS (SELECT 'run-' || user_id AS run_id, list(event_id) FILTER (WHERE event_type IN ('view', 'click')) AS d,
  list(event_id) FILTER (WHERE event_type = 'purchase' AND value > 10) AS tk, list(event_id) FILTER (WHERE event_type IN ('view', 'click') AND value > 4) AS c,
  list(event_id) FILTER (WHERE event_type = 'error' AND value < 1) AS f FROM events GROUP BY user_id)
SELECT run_id, CAST(coalesce(len(d), 0) + coalesce(len(tk), 0) AS BIGINT) AS total, CAST(coalesce(len(c), 0) AS BIGINT) AS completed,
CAST(coalesce(len(f), 0) AS BIGINT) AS failed, CAST(floor(coalesce(len(c), 0) / (coalesce(len(d), 0) + coalesce(len(tk), 0)) * 100 + 0.5) AS BIGINT) AS percent FROM e
WHERE coalesce(len(d), 0) + coalesce(len(tk), 0) > 0""")
def indexing_episodes(t: Tables) -> DataFrame:
    # One record per event, each with its own short id lists.
    kind, value, one = F.col("event_type"), F.col("value"), F.array("event_id")
    rows = t("events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.when(kind.isin("view", "click"), one).alias("document_ids"),
        F.when((kind == "purchase") & (value > 10), one).alias("task_ids"),
        F.when(kind.isin("view", "click") & (value > 4), one).alias("completed_ids"),
        F.when((kind == "error") & (value < 1), one).alias("failed_ids"))
    return rn.indexing_episodes(rows)


@query("run_accuracy", f"""WITH {BOARD_CTES} SELECT run_id, count(*) AS total, count(*) FILTER (WHERE evaluated) AS evaluated,
count(*) FILTER (WHERE evaluated AND score = 1) AS correct,
round(CASE WHEN count(*) FILTER (WHERE evaluated) > 0 THEN count(*) FILTER (WHERE evaluated AND score = 1) / count(*) FILTER (WHERE evaluated) END, 6) AS accuracy,
round(count(*) FILTER (WHERE evaluated AND score = 1) / count(*), 6) AS accuracy_all FROM bs GROUP BY run_id""")
def run_accuracy(t: Tables) -> DataFrame:
    return rn.run_accuracy(board_results(t))


# --- filters and lists -------------------------------------------------------------------------

@query("facet_counts", """SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def facet_counts(t: Tables) -> DataFrame:
    return fl.facet_counts(t("orders"), ["o_orderstatus", "o_orderpriority"])


@query("paged_list", """SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total, CAST(ceil((SELECT count(*) FROM orders) / 50) AS BIGINT) AS total_pages
FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""")
def paged_list(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", "o_orderdate")
    return fl.page(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey")], number=3, size=50)


@query("question_filter", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 200 OFFSET 50""")
def question_filter(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", "o_orderpriority")
    return fl.filter_rows(rows, isin={"o_orderpriority": ["1-URGENT", "2-HIGH"]}, order=["o_orderkey"], offset=50, limit=200)


@query("type_filter", """SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'HIGH') OR o_orderpriority = '5-LOW'""")
def type_filter(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", "o_orderpriority")
    lower = rows.withColumn("kind", F.lower("o_orderpriority"))
    by_part = fl.filter_rows(lower, contains={"kind": "HIGH"}).drop("kind")
    return by_part.unionByName(fl.filter_rows(rows, isin={"o_orderpriority": ["5-LOW"]}))


@query("status_filter", f"""WITH {PHASE_CTES}, e AS (SELECT * FROM pl WHERE phase = 'evaluate')
SELECT 'pending' AS wanted, run_id, question_id FROM e WHERE status NOT IN ('completed', 'failed')
UNION ALL SELECT 'failed', run_id, question_id FROM e WHERE status = 'failed' UNION ALL SELECT 'completed', run_id, question_id FROM e WHERE status = 'completed'
UNION ALL SELECT 'other', run_id, question_id FROM e""")
def status_filter(t: Tables) -> DataFrame:
    rows = phase_log(t).where(F.col("phase") == "evaluate")
    wanted = F.explode(F.array(*[F.lit(s) for s in ("pending", "failed", "completed", "other")]))
    each = rows.select(wanted.alias("wanted"), "run_id", "question_id", "status")
    keep = F.lit(False)
    for name in ("pending", "failed", "completed", "other"):
        keep = keep | ((F.col("wanted") == name) & fl.status_is(F.col("status"), name))
    return each.where(keep).drop("status")


@query("failures", """SELECT o_orderkey, o_orderstatus = 'P' AS strict, o_orderstatus = 'P' OR o_totalprice < 50000 AS lenient FROM orders""")
def failures(t: Tables) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "P", "incorrect").otherwise("correct")
    score = F.when(F.col("o_totalprice") < 50000, 0).otherwise(1)
    return t("orders").select("o_orderkey", fl.is_failure(label, score).alias("strict"),
                              fl.is_failure(label, score, strict=False).alias("lenient"))


@query("text_search", """SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ma') OR contains(lower(p_type), 'ma') OR contains(lower(p_partkey::VARCHAR), 'ma')""")
def text_search(t: Tables) -> DataFrame:
    return fl.filter_rows(t("part"), search="MA", search_cols=["p_name", "p_type", "p_partkey"]).select("p_partkey")


@query("facet_filter", """SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def facet_filter(t: Tables) -> DataFrame:
    return fl.filter_rows(t("customer"), isin={"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": []}).select("c_custkey", "c_mktsegment")


@query("stratified_sample", """SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 25""")
def stratified_sample(t: Tables) -> DataFrame:
    return sm.sample_questions(t("orders").select("o_orderkey", "o_orderpriority"), "sample", per_category=25,
                               type_col="o_orderpriority", pos="o_orderkey", id_col="o_orderkey")


@query("random_sample", """SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|7'), doc_id) <= 20""")
def random_sample(t: Tables) -> DataFrame:
    return sm.sample_questions(t("documents").select("doc_id", "lang"), "sample", per_category=20, seed=7, type_col="lang",
                               pos="doc_id", id_col="doc_id")


# --- comparisons and board ---------------------------------------------------------------------

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_TYPES_CTE = f"""{BOARD_CTES}, bt AS (SELECT bs.question_type, br.provider, list_position({_SEGMENTS!r}, br.provider) AS ord,
  round(count(*) FILTER (WHERE score = 1) / count(*), 6) AS accuracy FROM bs JOIN br USING (run_id) GROUP BY ALL)"""


def _by_type(t: Tables) -> DataFrame:
    rows = board_results(t).join(board_runs(t).select("run_id", "provider"), "run_id")
    place = F.array_position(F.array(*[F.lit(s) for s in _SEGMENTS]), F.col("provider"))
    return rows.groupBy("question_type", "provider").agg(
        F.round(F.count_if(F.col("score") == 1) / F.count("*"), 6).alias("accuracy")).withColumn("ord", place)


@query("provider_pivot", f"WITH {_TYPES_CTE} SELECT question_type, "
       + ", ".join(f"max(accuracy) FILTER (WHERE provider = '{s}') AS \"{s}\"" for s in _SEGMENTS)
       + ", arg_max(provider, {'a': accuracy, 'o': -ord}) AS best FROM bt GROUP BY question_type")
def provider_pivot(t: Tables) -> DataFrame:
    return cp.provider_pivot(_by_type(t), _SEGMENTS)


@query("question_types", f"WITH {_TYPES_CTE} SELECT DISTINCT question_type FROM bt")
def question_types(t: Tables) -> DataFrame:
    return cp.question_types(_by_type(t))


_WIN = f"""{PHASE_CTES}, {RUNS_CTE},
sm AS (SELECT compare_id, run_id AS provider, r.ord, x.accuracy FROM (SELECT compare_id, run_id, CAST(replace(run_id, 'run-', '') AS BIGINT) AS ord FROM runs) r
  JOIN (SELECT run_id, round(count(*) FILTER (WHERE score = 1) / count(*), 6) AS accuracy FROM pl WHERE phase = 'evaluate' GROUP BY run_id) x USING (run_id)),
lt AS (SELECT compare_id, run_id AS provider, CAST(replace(run_id, 'run-', '') AS BIGINT) AS ord, phase, floor(avg(duration_ms) / 1000 + 0.5) AS mean
  FROM pl JOIN runs USING (run_id) GROUP BY ALL)"""


@query("winners", f"""WITH {_WIN} SELECT compare_id, 'accuracy' AS measure, arg_max(provider, {{'a': accuracy, 'o': -ord}}) AS provider, true AS first_only
FROM sm GROUP BY compare_id UNION ALL
SELECT compare_id, phase, provider, provider = arg_min(provider, {{'m': mean, 'o': ord}}) OVER (PARTITION BY compare_id, phase) FROM lt
QUALIFY mean = min(mean) OVER (PARTITION BY compare_id, phase)""")
def winners(t: Tables) -> DataFrame:
    member = runs(t).select("compare_id", "run_id", F.replace("run_id", F.lit("run-"), F.lit("")).cast("bigint").alias("ord"))
    log = phase_log(t)
    accuracy = log.where(F.col("phase") == "evaluate").groupBy("run_id").agg(
        F.round(F.count_if(F.col("score") == 1) / F.count("*"), 6).alias("accuracy"))
    means = log.groupBy("run_id", "phase").agg(F.floor(F.avg("duration_ms") / 1000 + 0.5).alias("mean"))
    return cp.winners(member.join(accuracy, "run_id").withColumnRenamed("run_id", "provider"),
                      member.join(means, "run_id").withColumnRenamed("run_id", "provider"))


@query("compare_reports", f"""WITH {_STATUS}, {_DONE}, su AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE score = 1) AS correct FROM dn GROUP BY run_id)
SELECT compare_id, run_id, total, correct FROM runs JOIN su USING (run_id)""")
def compare_reports(t: Tables) -> DataFrame:
    return cp.compare_reports(runs(t).select("compare_id", "run_id"), _report(t)[0]).drop("accuracy")


@query("leaderboard_upsert", f"""WITH {BOARD_CTES} SELECT provider, benchmark, version, run_id, added_at, total, correct, accuracy FROM be
QUALIFY row_number() OVER (PARTITION BY provider, benchmark, version ORDER BY (run_id % 2 = 0) DESC, added_at DESC, run_id DESC) = 1""")
def leaderboard_upsert(t: Tables) -> DataFrame:
    entries = cp.leaderboard_entries(board_runs(t), board_results(t))
    return cp.leaderboard_upsert(entries.where(F.col("run_id") % 2 == 1), entries.where(F.col("run_id") % 2 == 0))


_RANKED = """SELECT id, provider, accuracy, row_number() OVER (ORDER BY accuracy DESC, id) AS rank
FROM (SELECT c_custkey AS id, c_mktsegment AS provider, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 0), 4) AS accuracy
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


@query("leaderboard_rank", _RANKED)
def leaderboard_rank(t: Tables) -> DataFrame:
    rows = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("provider")).agg(
        F.round(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)) / F.count("*"), F.lit(0.0)), 4).alias("accuracy"))
    return cp.leaderboard_rank(rows)


@query("leaderboard_types", f"""WITH {BOARD_CTES}, reg AS (SELECT DISTINCT benchmark, 'T-' || benchmark AS type_id FROM br)
SELECT be.run_id, be.accuracy, reg.type_id FROM be LEFT JOIN reg USING (benchmark)""")
def leaderboard_types(t: Tables) -> DataFrame:
    registry = board_runs(t).select("benchmark", F.concat(F.lit("T-"), F.col("benchmark")).alias("type_id")).distinct()
    return cp.board_with_types(cp.leaderboard_entries(board_runs(t), board_results(t)), registry).select("run_id", "accuracy", "type_id")
