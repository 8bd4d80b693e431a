import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import STOP_WORDS
from tidemark.functions.vectors import cosine
from tidemark.operators import blockmax
from tidemark.operators import index as ix
from tidemark.operators import search as se
from tidemark.operators.keyword import keyword_search
from tidemark.operators.retriever import RETRIEVERS

WORDS = "apple banana cherry date elder fig grape hazel iris jade kiwi lemon mango apples".split()


def tokens(text):
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return [t for t in out if len(t) > 1 and t not in STOP_WORDS]


def brute_bm25(chunks, query):
    docs = {i: tokens(c) for i, c in chunks}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in tokens(query):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            tf = d.count(term)
            if tf:
                idf = math.log((n - df + .5) / (df + .5) + 1)
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(d) / avg))
    return scores


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    np_rng = np.random.default_rng(5)
    chunks, queries = [], []
    for i in range(60):
        # One container holds most rows; some chunks have no vector or one of another length.
        box = "hot" if i % 4 else "cold"
        vec = np_rng.normal(size=8).tolist() if i % 7 else (None if i % 2 else [1.0, 2.0])
        chunks.append((box, f"c{i:03d}", " ".join(rng.choices(WORDS, k=rng.randint(0, 30))), vec))
    for i in range(6):
        queries.append((i, "hot" if i % 3 else "cold", " ".join(rng.choices(WORDS, k=4)) + " apple apple", np_rng.normal(size=8).tolist()))
    return (
        chunks, queries,
        spark.createDataFrame(chunks, "container string, chunk_id string, content string, embedding array<float>"),
        spark.createDataFrame(queries, "query_id int, container string, text string, embedding array<float>"),
    )


def brute_cosine(a, b):
    if b is None or len(a) != len(b):
        return 0.0
    a, b = np.asarray(a, dtype=np.float32).astype(float), np.asarray(b, dtype=np.float32).astype(float)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def brute_hybrid(chunks, query, k):
    qid, box, text, vec = query
    mine = [(c[1], c[2], c[3]) for c in chunks if c[0] == box]
    raw = brute_bm25([(i, c) for i, c, _ in mine], text)
    top = max(raw.values(), default=0)
    scored = [(round(.7 * brute_cosine(vec, v) + .3 * (raw.get(i, 0) / top if top else 0), 6), i) for i, _, v in mine]
    return [(qid, i, s) for s, i in sorted(scored, key=lambda p: (-p[0], p[1]))[:k]]


@pytest.mark.parametrize("part", [500_000, 7])
def test_bm25_matches_brute_force(world, monkeypatch, part):
    chunks, queries, cdf, qdf = world
    monkeypatch.setattr(blockmax, "PART_TERMS", part)
    got = {(r.query_id, r.chunk_id): r.bm25_raw for r in se.bm25_raw(qdf, ix.index_chunks(cdf)).collect()}
    want = {}
    for qid, box, text, _ in queries:
        for i, s in brute_bm25([(c[1], c[2]) for c in chunks if c[0] == box], text).items():
            want[qid, i] = s
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("k", [5, 200])
def test_hybrid_full(world, k):
    chunks, queries, cdf, qdf = world
    got = [(r.query_id, r.chunk_id, r.score) for r in se.hybrid_search(qdf, ix.index_chunks(cdf), k).orderBy("query_id", "rank").collect()]
    want = [row for q in queries for row in brute_hybrid(chunks, q, k)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_streamed_and_blocked_vectors_agree(world, rows):
    _, _, cdf, qdf = world
    a = rows(se.vector_top_k(qdf, cdf, 7))
    assert a == rows(se.vector_top_k(qdf, cdf, 7, broadcast_bytes=0))
    assert len(a) == 42


def test_small_blocks_give_the_same_rows(world, rows):
    from tidemark.operators.blocks import block_top_k

    _, _, cdf, qdf = world
    big = se._rank(block_top_k(qdf, cdf, None, 4, 1.0, 0.0), 4)
    small = se._rank(block_top_k(qdf, cdf, None, 4, 1.0, 0.0, chunk_block=5, query_block=2), 4)
    assert rows(se._shown(big)) == rows(se._shown(small))


def test_candidate_mode_keeps_the_nearest(world):
    _, _, cdf, qdf = world
    index = ix.index_chunks(cdf)
    near = {(r.query_id, r.chunk_id) for r in se.vector_top_k(qdf, cdf, 6).collect()}
    got = se.hybrid_search(qdf, index, 6, mode="candidates").collect()
    assert {(r.query_id, r.chunk_id) for r in got} == near
    assert all(0 <= r.bm25 <= 1 for r in got)


def test_missing_container_is_empty(spark, world):
    _, _, cdf, _ = world
    q = spark.createDataFrame([(1, "nowhere", "apple", [1.0] * 8)], "query_id int, container string, text string, embedding array<float>")
    assert se.hybrid_search(q, ix.index_chunks(cdf), 5).count() == 0
    assert se.bm25_top_k(q, ix.index_chunks(cdf), 5).count() == 0


def test_upsert_leaves_no_old_terms(spark, rows):
    schema = "container string, chunk_id string, content string"
    old = spark.createDataFrame([("a", "1", "apple pie"), ("a", "2", "plum")], schema)
    new = spark.createDataFrame([("a", "1", "cherry")], schema)
    both = ix.upsert_chunks(old, new)
    assert rows(ix.index_chunks(both).postings, "term", "chunk_id") == [("cherry", "1"), ("plum", "2")]
    assert rows(ix.upsert_chunks(both, new), "chunk_id", "content") == rows(both, "chunk_id", "content")


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1 / math.sqrt(2), 0, 0])


def brute_keyword(query, docs, k):
    terms = [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if len(t) > 1]
    out = []
    for i, text in docs:
        low = text.lower()
        hits = [t for t in terms if t in low]
        uses = sum(low.count(t) for t in hits)
        score = min(len(hits) / len(terms) + min(uses / 100, .1), 1.0) if terms else 0
        out.append((-round(score, 6), -len(hits), i))
    return [i for _, _, i in sorted(out)[:k]]


@pytest.mark.parametrize("fit", [True, False])
def test_keyword_search_matches_brute_force(spark, monkeypatch, fit):
    from tidemark.operators import keyword as kw

    monkeypatch.setattr(kw, "fits", lambda *a: fit)
    docs = [(i, t) for i, t in enumerate(["aaaa banana", "Banana-split ANANAS", "", "nothing here", "an an an", "x1y2 ban", "später banana"])]
    queries = [(0, "an banana aa"), (1, "zzz qq"), (2, "!"), (3, "ana here here")]
    ddf = spark.createDataFrame([("c", i, t) for i, t in docs], "container string, doc_id int, text string")
    qdf = spark.createDataFrame([(i, "c", t) for i, t in queries], "query_id int, container string, text string")
    for k in (3, 10):
        got = {}
        for r in keyword_search(qdf, ddf, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        assert got == {i: brute_keyword(t, docs, k) for i, t in queries}


def test_rerank(spark, rows):
    hits = spark.createDataFrame([(q, "c", f"d{i}", 1 - i / 10, i + 1) for q in (1, 2, 3) for i in range(3 if q < 3 else 2)],
                                 "query_id int, container string, chunk_id string, score double, rank int")
    scores = spark.createDataFrame([(1, 2, 8), (1, 0, 3), (3, 1, 9)], "query_id int, pos int, rerank int")
    got = rows(se.rerank(hits, scores, 2), "query_id", "rank", "chunk_id", "score")
    assert got == [(1, 1, "d2", 0.8), (1, 2, "d0", 0.3), (2, 1, "d0", 1.0), (2, 2, "d1", 0.9), (3, 1, "d0", 1.0), (3, 2, "d1", 0.9)]


def test_merge_subqueries(spark, rows):
    hits = spark.createDataFrame([(1, "c", 0, "a", .5, 1), (1, "c", 1, "a", .9, 1), (1, "c", 1, "b", .7, 2)],
                                 "query_id int, container string, sub int, chunk_id string, score double, rank int")
    assert rows(se.merge_subqueries(hits, 5), "chunk_id", "score", "rank") == [("a", .5, 2), ("b", .7, 1)]


@pytest.mark.parametrize("name", sorted(RETRIEVERS))
def test_retrievers(world, name):
    _, _, cdf, qdf = world
    back = RETRIEVERS[name]()
    back.index(cdf)
    got = back.search(qdf, 3).collect()
    assert {r.rank for r in got} <= {1, 2, 3} and {r.query_id for r in got} == set(range(6))


def test_block_maxima_lose_no_chunk(spark, rows, monkeypatch):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [("c" if k % 9 else "d", k, " ".join(rng.choices(words, k=rng.choice([0, 3, 40, 90, 300])))) for k in range(700)]
    texts += [("c", 700 + k, texts[10][2]) for k in range(30)] + [(None, 800, "w1 w2"), ("e", 801, None)]
    index = ix.index_chunks(spark.createDataFrame(texts, "container string, chunk_id bigint, content string"))
    asked = [(q, "c" if q % 5 else "d", " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 12])))) for q in range(40)]
    asked += [(50, "none", "w1"), (51, None, "w1"), (52, "c", "nowhere"), (53, "c", None)]
    terms = se.query_terms(spark.createDataFrame(asked, "query_id bigint, container string, text string"))
    monkeypatch.setattr(blockmax, "BLOCK", 32)
    stored = ix.Index(index.chunks, index.postings, index.stats)

    def best(frame):
        return rows(se.top_k(frame.withColumn("bm25_raw", F.round("bm25_raw", 6)), ["query_id", "container"],
                             [F.col("bm25_raw").desc(), F.col("chunk_id")], 5))

    want = best(blockmax.bm25_scores(terms, index, 1.2, 0.75))
    assert want and {r[0] for r in want} <= set(range(40))
    for own, part in ((index, 500_000), (stored, 500_000), (index, 30)):
        assert best(blockmax.bm25_scores(terms, own, 1.2, 0.75, 5, part)) == want


def test_blocks_score_few_chunks():
    rng = np.random.default_rng(2)
    n, terms = 3000, 6
    held = rng.random((n, terms)) < [0.9, 0.7, 0.5, 0.02, 0.01, 0.3]
    uses = rng.integers(1, 4, (n, terms))
    dl = rng.integers(50, 400, n)
    weights = np.log((n - held.sum(0) + 0.5) / (held.sum(0) + 0.5) + 1)
    batch = blockmax.Batch(pa.array([0]), ["c"], np.array([0, terms]), np.arange(terms), weights, {"c": float(dl.mean())}, 1.2, 0.75)
    rows = pa.record_batch({"container": ["c"] * n, "chunk_id": list(range(n)), "dl": dl,
                            "terms": [np.flatnonzero(h).astype(np.int32) for h in held], "uses": [u[h] for u, h in zip(uses, held)]})
    full = (held * weights * blockmax.gains(uses.astype(float), dl[:, None].astype(float), dl.mean(), 1.2, 0.75)).sum(1)
    least = np.sort(full)[-10]
    block = blockmax.Block(rows, batch)
    place, score, scored = block.scores(batch.terms, weights, least)
    assert sorted(place) == sorted(np.flatnonzero(full >= least)) and np.allclose(score, full[place])
    assert scored < 0.1 * (full > 0).sum()
    assert block.scores(batch.terms, weights, 1e9)[2] == 0
    assert len(block.scores(batch.terms, weights, -np.inf)[0]) == (full > 0).sum()


def test_blocks_are_compared_slice_by_slice(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidemark.operators import blocks

    monkeypatch.setattr(blocks, "CHUNK_BLOCK", 16)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 8)
    whole, shapes = blocks.cosine_block, []

    def watched(c, q):
        shapes.append((len(c), len(q)))
        return whole(c, q)

    monkeypatch.setattr(blocks, "cosine_block", watched)
    rng = np.random.default_rng(3)
    # Few different vectors: most places are decided by the ids.
    vectors = rng.integers(-1, 2, (90, 3)).astype(float).tolist()
    ids = rng.permutation(90).tolist()
    asked = rng.integers(-1, 2, (21, 3)).astype(float).tolist()
    schema = pa.schema([("query_id", pa.int64()), ("container", pa.string()), ("chunk_id", pa.int64()), ("vector", pa.float64()),
                        ("bm25", pa.float64()), ("score", pa.float64())])
    pairs = (pa.array([3, 3, 20]), pa.array([5, 80, 41]), np.array([.5, .25, 1.0]))
    for sparse, w in ((None, 0.0), (pairs, 0.3)):
        got = pa.concat_tables(blocks._by_slice(pa.array(ids), pa.array(vectors), pa.array(range(21)), pa.array(asked), "all", 4,
                                                0.7, w, sparse, schema)).to_pylist()
        assert all(n <= 16 and m <= 8 for n, m in shapes) and len(shapes) == 3 * 6
        shapes.clear()
        exact = whole(pa.array(vectors), pa.array(asked))
        for q in range(21):
            extra = {5: .5, 80: .25} if q == 3 else {41: 1.0} if q == 20 else {}
            want = sorted((-round(.7 * exact[row, q] + w * extra.get(i, 0), 6), i) for row, i in enumerate(ids))[:4]
            mine = sorted((-r["score"], r["chunk_id"]) for r in got if r["query_id"] == q)
            assert [i for _, i in want] == [i for _, i in mine][:4] and len(mine) == 4
    first = blocks._top(pa.array(ids[:40]), pa.array(vectors[:40]), pa.array(range(21)), pa.array(asked), "all", 4, 1.0, 0.0, schema=schema)
    both = blocks._top(pa.array(ids[40:]), pa.array(vectors[40:]), pa.array(range(21)), pa.array(asked), "all", 4, 1.0, 0.0,
                       schema=schema, found=first)
    once = blocks._top(pa.array(ids), pa.array(vectors), pa.array(range(21)), pa.array(asked), "all", 4, 1.0, 0.0, schema=schema)
    keyed = [("query_id", "ascending"), ("chunk_id", "ascending")]
    assert both.sort_by(keyed).equals(once.sort_by(keyed))


def test_blocks_do_not_deal_rows_by_container(spark):
    from tidemark.operators.blocks import block_top_k

    queries = spark.createDataFrame([(1, "c", [1.0, 0.0])], "query_id int, container string, embedding array<double>")
    chunks = spark.createDataFrame([("c", i, [1.0, float(i)]) for i in range(9)], "container string, chunk_id int, embedding array<double>")
    pairs = spark.createDataFrame([(1, "c", 4, .5)], "query_id int, container string, chunk_id int, bm25 double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = block_top_k(queries, chunks, pairs, 2, .7, .3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        best = sorted((-r.score, r.chunk_id) for r in se._rank(found, 2).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(container" in plan
    assert not __import__("re").search(r"hashpartitioning\(container#\d+, \d+\)", plan)
    assert best == [(-.7, 0), (-round(.7 / 2**.5, 6), 1)]


def test_terms_are_looked_up_in_steps_whatever_the_batch(monkeypatch):
    """One Arrow batch of many words is worked on piece by piece, and the pieces hold all rows."""
    from types import SimpleNamespace

    from tidemark.plans.batches import gathered, steps

    monkeypatch.setattr(blockmax, "STEP", 100)
    names = [[f"w{(r + k) % 50}" for k in range(r % 30)] for r in range(300)] + [[f"w{k}" for k in range(50)] * 5, None]
    batch = pa.record_batch({"container": pa.array(["c"] * 302), "chunk_id": pa.array(range(302)), "dl": pa.array([len(n or []) for n in names]),
                             "names": pa.array(names, pa.list_(pa.string())), "uses": pa.array([[1] * len(n or []) for n in names], pa.list_(pa.int64()))})
    asked = SimpleNamespace(value=blockmax._joined(pa.array(["c", "c"]), pa.array(["w3", "w7"])))
    out = list(blockmax._keep(asked, ["container", "chunk_id", "dl", "terms", "uses"])(iter([batch, batch.slice(0, 0)])))
    assert len(out) > 40 and max(b.num_rows for b in out) < 60
    got = pa.Table.from_batches(out).to_pylist()
    assert [r["chunk_id"] for r in got] == list(range(302))
    assert [r["terms"] for r in got] == [[("w3", "w7").index(w) for w in n or [] if w in ("w3", "w7")] for n in names]
    assert list(steps(np.array([], np.int64), 5)) == [] and list(steps(np.array([9, 1, 1, 9]), 5)) == [(0, 1), (1, 2), (2, 4)]
    assert [t.num_rows for t in gathered([batch] * 5, 700, 1 << 40)] == [906, 604]


def test_terms_inside_words_match_brute_force():
    from tidemark.operators.keyword import Terms

    rng = random.Random(3)
    words = ["".join(rng.choices("ab1", k=rng.choice([2, 3, 5, 9, 14, 30]))) for _ in range(400)] + ["aaaaa", "z" * 40, ""]
    words = sorted(set(words))
    terms = sorted({"".join(rng.choices("ab1", k=rng.choice([2, 3, 4, 6]))) for _ in range(60)}
                   | {w[3:] for w in words if len(w) == 30} | {"aa", "z" * 13, "z" * 12, "z" * 12 + "y", words[-1], "0z"})
    got = [(int(w), int(t), int(n)) for w, t, n in zip(*Terms(terms).inside(pa.array(words, pa.string())), strict=True)]
    assert sorted(got) == got
    assert got == [(w, t, word.count(term)) for w, word in enumerate(words) for t, term in enumerate(terms) if term in word]
    assert [len(x) for x in Terms([]).inside(pa.array(["ab"]))] == [0, 0, 0] == [len(x) for x in Terms(["ab"]).inside(pa.array([], pa.string()))]


@pytest.mark.parametrize("fit", [True, False])
def test_keyword_search_sends_few_rows_on(spark, monkeypatch, rows, fit):
    """Nearly every document matches every query, but only about the first rows of each leave a task."""
    from tidemark.operators import keyword as kw

    monkeypatch.setattr(kw, "fits", lambda *a: fit)
    rng = random.Random(4)
    docs = [("c" if d % 3 else "d", d, " ".join(rng.choices(WORDS, k=rng.choice([0, 4, 9, 40])))) for d in range(900)]
    queries = [(q, "cd"[q % 2], " ".join(rng.choices(WORDS, k=5))) for q in range(12)] + [(20, "e", "apple"), (21, None, "apple"), (22, "c", "!")]
    ddf = spark.createDataFrame([*docs, (None, 990, "apple"), ("c", 991, None)], "container string, doc_id int, text string").coalesce(2)
    qdf = spark.createDataFrame(queries, "query_id int, container string, text string")
    index = kw.build_keyword_index(ddf)
    few = kw.keyword_scores(qdf, index, 3)
    assert kw.keyword_scores(qdf, index).count() > 2000 and few.count() < 700
    got = {}
    for r in kw.keyword_search(qdf, index, 3, backfill=False).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: brute_keyword(t, [(d, x) for c, d, x in docs if c == box], 3) for q, box, t in queries[:12]}
