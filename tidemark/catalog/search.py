"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_subquery_lines, plain_tokens
from ..functions.vectors import cosine
from ..operators import index as ix
from ..operators import search as se
from ..operators.keyword import keyword_search
from .base import Tables, query
from .shapes import D_CORPUS, bm25_ctes, corpus, corpus_by_source, corpus_with_vectors, items, items_with_vectors, one_container

_TOP = "row_number() OVER (PARTITION BY query_id, container ORDER BY {0} DESC, chunk_id)"


@query("bm25_topk", f"""WITH {bm25_ctes()},
r AS (SELECT query_id, container, chunk_id, round(bm25_raw, 6) AS bm25_raw FROM raw),
k AS (SELECT *, {_TOP.format('bm25_raw')} AS rank FROM r QUALIFY rank <= 10)
SELECT query_id, container, chunk_id, bm25_raw, rank,
  round(bm25_raw / max(bm25_raw) OVER (PARTITION BY query_id, container), 6) AS bm25 FROM k""")
def bm25_topk(t: Tables) -> DataFrame:
    return se.bm25_top_k(items(t), ix.index_chunks(corpus(t)), 10)


@query("bm25_normalised", f"""WITH {bm25_ctes()}
SELECT query_id, container, chunk_id, round(bm25_raw, 6) AS bm25_raw,
  round(bm25_raw / max(bm25_raw) OVER (PARTITION BY query_id, container), 6) AS bm25 FROM raw""")
def bm25_normalised(t: Tables) -> DataFrame:
    return se.bm25(items(t), ix.index_chunks(corpus(t))).withColumns(
        {c: F.round(c, 6) for c in ("bm25_raw", "bm25")})


_SOURCES = "d AS (SELECT source AS container, doc_id AS chunk_id, text FROM documents)"


@query("term_stats", f"""WITH {bm25_ctes(_SOURCES)} SELECT container, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf
FROM tf GROUP BY ALL""")
def term_stats(t: Tables) -> DataFrame:
    return ix.postings(corpus_by_source(t)).groupBy("container", "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


@query("corpus_stats", f"""WITH {bm25_ctes(_SOURCES)} SELECT container, count(*) AS n_docs,
CAST(sum(dl) AS BIGINT) AS total_len, round(sum(dl) / count(*), 6) AS avgdl FROM dl GROUP BY container""")
def corpus_stats(t: Tables) -> DataFrame:
    return ix.corpus_stats(corpus_by_source(t)).withColumn("avgdl", F.round("avgdl", 6))


@query("token_lists", """SELECT doc_id,
CAST(len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS BIGINT) AS n_plain,
array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1), ' ') AS plain
FROM documents""")
def token_lists(t: Tables) -> DataFrame:
    tokens = plain_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(tokens).cast("bigint").alias("n_plain"),
                                 F.array_join(tokens, " ").alias("plain"))


@query("doc_lengths", f"""WITH {bm25_ctes()} SELECT container, chunk_id, CAST(dl AS BIGINT) AS dl FROM dl""")
def doc_lengths(t: Tables) -> DataFrame:
    return ix.index_chunks(corpus(t)).doc_len().withColumn("dl", F.col("dl").cast("bigint"))


_COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"


@query("cosine_topk", f"""WITH s AS (SELECT a.vec_id AS query_id, 'all' AS container, b.vec_id AS chunk_id,
  round({_COS.format('a.embedding', 'b.embedding')}, 6) AS vector FROM embeddings a, embeddings b)
SELECT *, {_TOP.format('vector')} AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk(t: Tables) -> DataFrame:
    vectors = t("embeddings").select(F.lit("all").alias("container"), "vec_id", "embedding")
    return se.vector_top_k(vectors.withColumnRenamed("vec_id", "query_id"),
                           vectors.withColumnRenamed("vec_id", "chunk_id"), 10)


@query("cosine_topk_blocks", f"""WITH s AS (SELECT a.vec_id AS query_id, 'label-' || a.label AS container, b.vec_id AS chunk_id,
  round({_COS.format('a.embedding', 'b.embedding')}, 6) AS vector FROM embeddings a JOIN embeddings b ON a.label = b.label)
SELECT *, {_TOP.format('vector')} AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk_blocks(t: Tables) -> DataFrame:
    tag = F.concat(F.lit("label-"), F.col("label").cast("string"))
    vectors = t("embeddings").select(tag.alias("container"), "vec_id", "embedding")
    return se.vector_top_k(vectors.withColumnRenamed("vec_id", "query_id"),
                           vectors.withColumnRenamed("vec_id", "chunk_id"), 10, broadcast_bytes=0)


@query("cosine_function", f"""SELECT a.vec_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_function(t: Tables) -> DataFrame:
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


_VECTORS = f"""qv AS (SELECT q.query_id, q.container, CASE WHEN e.vec_id % 5 <> 3 THEN e.embedding END AS embedding
  FROM q LEFT JOIN embeddings e ON e.vec_id = q.query_id),
dv AS (SELECT d.container, d.chunk_id, e.embedding FROM d LEFT JOIN embeddings e ON e.vec_id = d.chunk_id),
cv AS (SELECT qv.query_id, qv.container, dv.chunk_id,
  coalesce({_COS.format('qv.embedding', 'dv.embedding')}, 0) AS vector
  FROM qv JOIN dv ON dv.container = qv.container)"""


@query("hybrid_topk", f"""WITH {bm25_ctes()}, {_VECTORS},
nb AS (SELECT query_id, container, chunk_id, bm25_raw / max(bm25_raw) OVER (PARTITION BY query_id, container) AS bm25
  FROM raw),
s AS (SELECT cv.*, coalesce(nb.bm25, 0) AS bm25, round(0.7::DOUBLE * vector + 0.3::DOUBLE * coalesce(nb.bm25, 0), 6) AS score
  FROM cv LEFT JOIN nb USING (query_id, container, chunk_id) JOIN qv USING (query_id, container)
  WHERE qv.embedding IS NOT NULL OR nb.bm25 IS NOT NULL)
SELECT query_id, container, chunk_id, round(vector, 6) AS vector, round(bm25, 6) AS bm25, score,
  {_TOP.format('score')} AS rank FROM s QUALIFY rank <= 20""")
def hybrid_topk(t: Tables) -> DataFrame:
    return se.hybrid_search(items_with_vectors(t), ix.index_chunks(corpus_with_vectors(t)), 20)


@query("hybrid_candidates", f"""WITH {bm25_ctes()}, {_VECTORS},
near AS (SELECT * FROM (SELECT cv.*, {_TOP.format('round(vector, 6)')} AS vr FROM cv JOIN qv USING (query_id, container)
    WHERE embedding IS NOT NULL QUALIFY vr <= 20)
  UNION ALL SELECT query_id, container, chunk_id, 0, 0 FROM raw JOIN qv USING (query_id, container) WHERE embedding IS NULL),
j AS (SELECT near.query_id, near.container, near.chunk_id, near.vector, coalesce(raw.bm25_raw, 0) AS b
  FROM near LEFT JOIN raw USING (query_id, container, chunk_id)),
n AS (SELECT query_id, container, chunk_id, vector, CASE WHEN max(b) OVER (PARTITION BY query_id, container) > 0
  THEN b / max(b) OVER (PARTITION BY query_id, container) ELSE 0 END AS bm25 FROM j),
s AS (SELECT *, round(0.7::DOUBLE * vector + 0.3::DOUBLE * bm25, 6) AS score FROM n)
SELECT query_id, container, chunk_id, round(vector, 6) AS vector, round(bm25, 6) AS bm25, score,
  {_TOP.format('score')} AS rank FROM s QUALIFY rank <= 20""")
def hybrid_candidates(t: Tables) -> DataFrame:
    return se.hybrid_search(items_with_vectors(t), ix.index_chunks(corpus_with_vectors(t)), 20, mode="candidates")


@query("keyword_coverage_topk", """WITH q AS (SELECT item_id AS query_id, text FROM benchmark),
qt AS (SELECT query_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM q),
qf AS (SELECT query_id, term, count(*) AS qtf FROM qt WHERE length(term) > 1 GROUP BY ALL),
qn AS (SELECT query_id, sum(qtf) AS n FROM qf GROUP BY query_id),
terms AS (SELECT DISTINCT term FROM qf),
u AS (SELECT term, doc_id, (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS uses
  FROM terms JOIN documents ON contains(lower(text), term)),
m AS (SELECT query_id, doc_id, sum(qtf) AS match_count, sum(qtf * uses) AS uses FROM qf JOIN u USING (term) GROUP BY ALL),
s AS (SELECT q.query_id, d.doc_id, CAST(coalesce(match_count, 0) AS BIGINT) AS match_count,
  round(least(coalesce(match_count, 0)::DOUBLE / qn.n + least(coalesce(uses, 0)::DOUBLE / 100, 0.1), 1.0), 6) AS score
  FROM q JOIN qn USING (query_id) CROSS JOIN documents d LEFT JOIN m ON m.query_id = q.query_id AND m.doc_id = d.doc_id)
SELECT query_id, 'src' AS container, doc_id, score, match_count,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_count DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def keyword_coverage_topk(t: Tables) -> DataFrame:
    docs = t("documents").select(one_container("doc_id").alias("container"), "doc_id", "text")
    return keyword_search(items(t), docs, 10)




_TWO = """q AS (SELECT item_id AS query_id, 'src' || unnest([item_id % 20, (item_id + 7) % 20]) AS container, text FROM benchmark)"""


@query("multi_container_search", f"""WITH {bm25_ctes(_SOURCES, _TWO)},
r AS (SELECT query_id, container, chunk_id, round(bm25_raw, 6) AS bm25_raw FROM raw)
SELECT *, {_TOP.format('bm25_raw')} AS rank FROM r QUALIFY rank <= 10""")
def multi_container_search(t: Tables) -> DataFrame:
    names = F.array(F.col("item_id") % 20, (F.col("item_id") + 7) % 20)
    scoped = t("benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.explode(names).alias("n")
    ).select("query_id", F.concat(F.lit("src"), F.col("n").cast("string")).alias("container"), "text")
    return se.bm25_top_k(scoped, ix.index_chunks(corpus_by_source(t)), 10).drop("bm25")


_LINES = r"""list_slice(list_filter(list_transform(string_split(trim(text), chr(10)),
  lambda l: trim(regexp_replace(l, '^[-*\d.)\s]+', ''))), lambda l: length(l) > 3 AND length(l) < 200), 1, 5)"""
_SUBQ = f"""s0 AS (SELECT item_id AS query_id, text, 0 AS sub FROM benchmark UNION ALL
  SELECT item_id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS sub FROM (SELECT item_id, {_LINES} AS l FROM benchmark)),
q AS (SELECT query_id * 100 + sub AS query_id, 'src' AS container, text FROM s0)"""


@query("subquery_merge", f"""WITH {bm25_ctes(D_CORPUS, _SUBQ)},
r AS (SELECT query_id, container, chunk_id, round(bm25_raw, 6) AS bm25_raw FROM raw),
k AS (SELECT *, {_TOP.format('bm25_raw')} AS rank FROM r QUALIFY rank <= 10),
n AS (SELECT query_id // 100 AS query_id, query_id % 100 AS sub, container, chunk_id, rank,
  round(bm25_raw / max(bm25_raw) OVER (PARTITION BY query_id, container), 6) AS score FROM k),
o AS (SELECT query_id, container, chunk_id, sub, score FROM n
  QUALIFY row_number() OVER (PARTITION BY query_id, container, chunk_id ORDER BY sub, rank) = 1)
SELECT *, {_TOP.format('score')} AS rank FROM o QUALIFY rank <= 10""")
def subquery_merge(t: Tables) -> DataFrame:
    whole = t("benchmark").select("item_id", F.lit(0).cast("bigint").alias("sub"), "text")
    lines = t("benchmark").select("item_id", F.posexplode(clean_subquery_lines(F.col("text"))).alias("i", "text"))
    subs = whole.unionByName(lines.select("item_id", (F.col("i") + 1).cast("bigint").alias("sub"), "text"))
    scoped = subs.select((F.col("item_id") * 100 + F.col("sub")).alias("query_id"), F.lit("src").alias("container"), "text")
    hits = se.bm25_top_k(scoped, ix.index_chunks(corpus(t)), 10).select(
        F.floor(F.col("query_id") / 100).alias("query_id"), (F.col("query_id") % 100).alias("sub"), "container",
        "chunk_id", "rank", F.col("bm25").alias("score"))
    return se.merge_subqueries(hits, 10)


@query("rerank_topk", f"""WITH {bm25_ctes()},
r AS (SELECT query_id, container, chunk_id, round(bm25_raw, 6) AS bm25_raw FROM raw),
k AS (SELECT *, {_TOP.format('bm25_raw')} AS rank FROM r QUALIFY rank <= 40),
n AS (SELECT query_id, container, chunk_id, rank, round(bm25_raw / max(bm25_raw) OVER (PARTITION BY query_id, container), 6)
  AS bm25, count(*) OVER (PARTITION BY query_id, container) AS c FROM k),
l AS (SELECT n.query_id, n.rank, labels.quality * 7 + labels.toxic * 2 AS rerank FROM n JOIN labels ON labels.doc_id = n.chunk_id),
h AS (SELECT DISTINCT query_id FROM l),
u AS (SELECT n.query_id, n.container, n.chunk_id, n.rank AS old, n.bm25, (h.query_id IS NOT NULL AND n.c > 20) AS used,
  CASE WHEN h.query_id IS NOT NULL AND n.c > 20 THEN coalesce(l.rerank, 0)::DOUBLE END AS rerank_score
  FROM n LEFT JOIN l ON l.query_id = n.query_id AND l.rank = n.rank LEFT JOIN h ON h.query_id = n.query_id)
SELECT query_id, container, chunk_id, rerank_score, CASE WHEN used THEN rerank_score / 10 ELSE bm25 END AS score,
  row_number() OVER (PARTITION BY query_id, container ORDER BY coalesce(rerank_score, 0) DESC, old) AS rank
FROM u QUALIFY rank <= 20""")
def rerank_topk(t: Tables) -> DataFrame:
    hits = se.bm25_top_k(items(t), ix.index_chunks(corpus(t)), 40).select(
        "query_id", "container", "chunk_id", F.col("bm25").alias("score"), "rank")
    labels = t("labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") * 7 + F.col("toxic") * 2).alias("rerank"))
    scores = hits.join(labels, "chunk_id").select("query_id", (F.col("rank") - 1).alias("pos"), "rerank")
    return se.rerank(hits, scores, 20)


@query("query_rewrite", """SELECT b.item_id AS query_id,
CASE WHEN length(trim(d.text)) > 0 AND length(trim(d.text)) <= 500 THEN trim(d.text) ELSE b.text END AS text
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id""")
def query_rewrite(t: Tables) -> DataFrame:
    rewrites = t("documents").select(F.col("doc_id").alias("query_id"), "text")
    return se.effective_query(items(t), rewrites).select("query_id", "text")


@query("list_containers", """SELECT DISTINCT c AS container, CASE WHEN starts_with(c, 'repo-') THEN 'repo' ELSE 'personal' END AS kind
FROM (SELECT CASE lang WHEN 'de' THEN 'repo-' || source WHEN 'fr' THEN source || '-v1.2' ELSE source END AS c FROM documents)
WHERE NOT contains(c, '-v1.') AND NOT contains(c, '_abs-')""")
def list_containers(t: Tables) -> DataFrame:
    name = F.when(F.col("lang") == "de", F.concat(F.lit("repo-"), F.col("source"))).when(
        F.col("lang") == "fr", F.concat(F.col("source"), F.lit("-v1.2"))).otherwise(F.col("source"))
    return ix.list_containers(t("documents").select(name.alias("container")))


@query("result_defaults", """SELECT d.doc_id, coalesce(CASE WHEN d.n_chars < 400 THEN d.text END, '') AS content,
coalesce(l.quality::DOUBLE, 0) AS score, coalesce(CASE WHEN l.toxic = 1 THEN 'entity' END, 'chunk') AS row_type
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def result_defaults(t: Tables) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left")
    out = se.result_rows(rows, F.when(F.col("n_chars") < 400, F.col("text")), F.col("quality").cast("double"),
                         F.when(F.col("toxic") == 1, F.lit("entity")))
    return out.select("doc_id", "content", "score", "row_type")


@query("chunk_upsert", """WITH o AS (SELECT source AS container, doc_id AS chunk_id, lower(text) AS content FROM documents),
n AS (SELECT source AS container, d.doc_id AS chunk_id, 'new ' || text AS content FROM documents d JOIN labels l USING (doc_id))
SELECT o.container, o.chunk_id, coalesce(n.content, o.content) AS content FROM o LEFT JOIN n USING (container, chunk_id)""")
def chunk_upsert(t: Tables) -> DataFrame:
    old = t("documents").select(F.col("source").alias("container"), F.col("doc_id").alias("chunk_id"), F.lower("text").alias("content"))
    new = t("documents").join(t("labels"), "doc_id", "left_semi").select(
        F.col("source").alias("container"), F.col("doc_id").alias("chunk_id"), F.concat(F.lit("new "), F.col("text")).alias("content"))
    return ix.upsert_chunks(old, new)


@query("container_clear", """SELECT source AS container, doc_id AS chunk_id FROM documents WHERE source NOT IN (
SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source HAVING count(*) > 2)""")
def container_clear(t: Tables) -> DataFrame:
    bad = t("documents").join(t("labels").where("toxic = 1"), "doc_id").groupBy("source").count().where("count > 2")
    return ix.clear_container(corpus_by_source(t).drop("content"), bad.select(F.col("source").alias("container")))


@query("session_chunk_counts", """SELECT source AS container, lang AS session_id, count(*) AS n_chunks,
string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE source = 'src1' AND lang = 'en' GROUP BY ALL""")
def session_chunk_counts(t: Tables) -> DataFrame:
    chunks = t("documents").select(F.col("source").alias("container"), F.col("lang").alias("session_id"),
                                   F.col("doc_id").alias("chunk_index"))
    return ix.session_chunks(chunks, "src1", "en").groupBy("container", "session_id").agg(
        F.count("*").alias("n_chunks"),
        F.array_join(F.transform(F.sort_array(F.collect_list("chunk_index")), lambda x: x.cast("string")), ",").alias("ids"))



