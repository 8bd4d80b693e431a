import random

import pytest

from tidemark.operators import graph as gr

ENT = "container string, name string, type string, summary string"
EDGE = "container string, source string, relation string, target string, ord bigint"
SEED = "query_id int, container string, name string, ord int"


def brute_khop(seeds, edges, nodes, hops, cap_nodes, cap_edges):
    near = {}
    seen = set()
    for s, r, t, _ in sorted(edges, key=lambda e: e[3]):
        if (s, r, t) in seen:
            continue
        seen.add((s, r, t))
        near.setdefault(s, []).append((s, r, t))
        if s != t:
            near.setdefault(t, []).append((s, r, t))
    order, crossed, frontier = [], [], []
    for name in seeds:
        if name not in order:
            order.append(name)
            frontier.append(name)
    for _ in range(hops):
        nxt = []
        for name in frontier:
            for e in near.get(name, []):
                if e in crossed:
                    continue
                crossed.append(e)
                other = e[2] if e[0] == name else e[0]
                if other not in order:
                    order.append(other)
                    nxt.append(other)
        frontier = nxt
    return [n for n in order if n in nodes][:cap_nodes], crossed[:cap_edges]


def brute_bfs(seeds, edges, hops, per_node, stop):
    visited, queue, names, rels = set(), [(s, 0) for s in seeds], [], []
    while queue and len(rels) < stop:
        name, depth = queue.pop(0)
        if name in visited:
            continue
        visited.add(name)
        around = [(e[2], e) for e in edges if e[0] == name] + [(e[0], e) for e in edges if e[2] == name]
        for other, e in around[:per_node]:
            names.append(other)
            rels.append(e[:3])
            if other not in visited and depth + 1 <= hops:
                queue.append((other, depth + 1))
    return list(dict.fromkeys(names)), list(dict.fromkeys(rels))


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(names), rng.choice("rs"), rng.choice(names), i) for i in range(40)]
    edges += [("n1", "r", "n1", 100), ("hub", "r", "n2", 101), ("hub", "r", "n3", 102)]
    edges += [("n0", "x", f"leaf{i}", 200 + i) for i in range(40)]
    nodes = names[:10] + ["leaf3"]
    return (
        edges, nodes,
        spark.createDataFrame([("g", *e) for e in edges], EDGE),
        spark.createDataFrame([("g", n, "t", f"about {n}") for n in nodes], ENT),
    )


@pytest.mark.parametrize("caps", [(10, 20), (3, 4), (100, 1000)])
def test_khop(spark, net, caps):
    edges, nodes, edf, ndf = net
    seeds = {1: ["n4", "n7"], 2: ["hub"], 3: ["n0"], 4: ["absent"]}
    sdf = spark.createDataFrame([(q, "g", n, i) for q, ns in seeds.items() for i, n in enumerate(ns)], SEED)
    found, rels = gr.khop(sdf, edf, ndf, 2, *caps)
    got_n, got_e = {}, {}
    for r in found.orderBy("query_id", "pos").collect():
        got_n.setdefault(r.query_id, []).append(r.name)
    for r in rels.orderBy("query_id", "pos").collect():
        got_e.setdefault(r.query_id, []).append((r.source, r.relation, r.target))
    for q, ns in seeds.items():
        want_n, want_e = brute_khop(ns, edges, nodes, 2, *caps)
        assert got_n.get(q, []) == want_n
        assert got_e.get(q, []) == want_e


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_khop_stops_where_the_caps_are_reached(spark, hops):
    rng = random.Random(hops)
    # Two hubs with many leaves, most of them no nodes, and a sparse net between.
    names = [f"m{i}" for i in range(30)]
    edges = [(rng.choice(names), rng.choice("rs"), rng.choice(names), i) for i in range(45)]
    edges += [("m0" if i % 2 else "m1", "x", f"leaf{i}", 300 - i) for i in range(120)]
    nodes = names[::2] + [f"leaf{i}" for i in range(0, 120, 7)]
    edf = spark.createDataFrame([("g", *e) for e in edges], EDGE)
    ndf = spark.createDataFrame([("g", n, "t", n) for n in nodes], ENT)
    seeds = {q: rng.sample(names + ["leaf3", "leaf14"], 1 + q % 3) for q in range(12)}
    sdf = spark.createDataFrame([(q, "g", n, i) for q, ns in seeds.items() for i, n in enumerate(ns)], SEED)
    for caps in ((2, 3), (6, 9)):
        got = [{}, {}]
        for side, rows in enumerate(gr.khop(sdf, edf, ndf, hops, *caps)):
            for r in rows.orderBy("query_id", "pos").collect():
                got[side].setdefault(r.query_id, []).append((r.source, r.relation, r.target) if side else r.name)
        for q, ns in seeds.items():
            want = brute_khop(ns, edges, nodes, hops, *caps)
            assert [got[side].get(q, []) for side in (0, 1)] == list(want)
    for strict in (False, True):
        counts = {r.query_id: r.n for r in gr.khop_edge_counts(sdf, edf, ndf, hops, strict).collect()}
        for q, ns in seeds.items():
            used = [n for n in ns if n in nodes or not strict]
            assert counts.get(q, 0) == len(brute_khop(used, edges, nodes, hops, 0, 10**9)[1])


def test_khop_can_ask_for_seed_nodes(spark, net):
    _, _, edf, ndf = net
    sdf = spark.createDataFrame([(2, "g", "hub", 0)], SEED)
    found, rels = gr.khop(sdf, edf, ndf, 2, require_seed_node=True)
    assert found.count() == rels.count() == 0


@pytest.mark.parametrize("per_node,stop", [(30, 200), (4, 9), (30, 35)])
def test_deep_bfs(spark, net, per_node, stop):
    edges, _, edf, _ = net
    order = sorted(edges, key=lambda e: e[3])
    seeds = {1: ["n4", "n7"], 2: ["hub"], 3: ["n0"], 4: ["absent"]}
    sdf = spark.createDataFrame([(q, "g", n, i) for q, ns in seeds.items() for i, n in enumerate(ns)], SEED)
    names, rels = gr.deep_bfs(sdf, edf, 2, per_node, stop)
    got_n, got_r = {}, {}
    for r in names.orderBy("query_id", "pos").collect():
        got_n.setdefault(r.query_id, []).append(r.name)
    for r in rels.orderBy("query_id", "pos").collect():
        got_r.setdefault(r.query_id, []).append((r.source, r.relation, r.target))
    for q, ns in seeds.items():
        want_n, want_r = brute_bfs(ns, order, 2, per_node, stop)
        assert got_n.get(q, []) == want_n
        assert got_r.get(q, []) == want_r


def brute_merge(rows, always):
    kind = text = None
    for t, s in rows:
        if text is None:
            kind, text = t.lower(), s
        elif always:
            text = (text + " " + s)[:500]
        elif s and s[:40] not in text:
            text = (text + " " + s)[:500]
    return kind, text


@pytest.mark.parametrize("always", [False, True])
def test_merge_entities(spark, always):
    rng = random.Random(2)
    groups = {
        "few": [("Person", "likes tea"), ("X", "tea"), ("X", ""), ("X", "likes coffee")],
        "many": [("Org", "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))) for _ in range(400)],
        "long": [("Org", "q" * 700), ("Org", "z")],
        "alone": [("Org", "q" * 800), ("Org", "q" * 50), ("Org", "")],
        "exact": [("Org", "q" * 500), ("Org", "z")],
        "empty": [("Org", ""), ("Org", "late")],
    }
    rows = [("g", f" {n} ", t, s, f"s{i % 3}", i) for n, part in groups.items() for i, (t, s) in enumerate(part)]
    rows.append(("g", "  ", "t", "blank name", "s", 0))
    df = spark.createDataFrame(rows, "container string, name string, type string, summary string, session_id string, ord int")
    got = {r.name: (r.type, r.summary, r.n_sessions) for r in gr.merge_entities(df, always_append=always).collect()}
    assert got.keys() == groups.keys()
    for name, part in groups.items():
        kind, text = brute_merge(part, always)
        assert got[name] == (kind, text, len(part) if always else min(3, len(part)))


def test_mentions(spark, rows):
    ent = spark.createDataFrame([("g", n, "t", "") for n in ("Tom", "Tomato Soup", "New York City", "Al", "C# Club")], ENT)
    q = spark.createDataFrame([(1, "g", "is tom in NEW YORK city?"), (2, "g", "tomatoes"), (3, "g", "some soup"), (4, "h", "tom")],
                              "query_id int, container string, text string")
    assert rows(gr.match_mentions(q, ent), "query_id", "name") == [(1, "New York City"), (1, "Tom"), (3, "Tomato Soup")]
    like = rows(gr.match_mentions(q, ent, "like"), "query_id", "name")
    assert (1, "Tomato Soup") in like and (1, "Tom") in like and (2, "Tomato Soup") not in like


def test_graph_context_rows(spark, rows):
    ent = spark.createDataFrame([("g", "carlos", "person", "an engineer"), ("g", "spotify", "company", "music")], ENT)
    edges = spark.createDataFrame([("g", "carlos", "works_at", "spotify", 0)], EDGE)
    q = spark.createDataFrame([(1, "g", "where does Carlos work")], "query_id int, container string, text string")
    got = rows(gr.graph_context(q, ent, edges), "row_type", "pos", "content")
    assert got == [("entity", 1, "an engineer"), ("entity", 2, "music"), ("relationship", 1, "carlos works_at spotify")]


def test_deep_seeds(spark, rows):
    q = spark.createDataFrame([(1, "g", "where is anna"), (2, "g", "zz")], "query_id int, container string, text string")
    rel = spark.createDataFrame([(1, "g", "Anna Lee", "Paris", 0), (1, "g", "Bob", "anna lee", 1), (2, "g", "", "Rome", 0), (2, "g", "Oslo", "X", 1)],
                                "query_id int, container string, source string, target string, ord int")
    assert rows(gr.deep_seeds(q, rel), "query_id", "name") == [(1, "anna_lee"), (2, "rome")]
