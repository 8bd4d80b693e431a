"""Entity graph: merging, mention matching and bounded traversal for a batch of queries.

Entities are ``(container, name, type, summary)``, edges ``(container, source, relation, target,
ord[, date, session_id])``; ``ord`` is the arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import graph_key, name_keys, trim_space, word_sequence
from ..plans.scratch import cut_lineage
from ..plans.skew import WINDOW_LIMIT, first_row, fits, salted_join, top_k

# Output and traversal limits.
MAX_ENTITIES = 10
MAX_EDGES = 20
SUMMARY_CHARS = 500
PREFIX_CHARS = 40
NEIGHBOUR_CAP = 30
RELATION_STOP = 200


def merge_entities(mentions: DataFrame, order: str = "ord", always_append: bool = False,
                   most: int = SUMMARY_CHARS, prefix: int = PREFIX_CHARS) -> DataFrame:
    """Fold mentions ``(container, name, type, summary, session_id, ord)`` into one row per entity.

    The first type wins, lower-cased. The first summary is taken in full. A later one is appended
    unless its first ``prefix`` characters already occur, and an append cuts the text at ``most``
    characters; ``always_append`` skips that test.

    The fold is exact on few rows: an append adds at least one character, and a later row with a
    prefix seen before never changes the text. Only the rows that can still matter are gathered.
    A first summary of ``most`` characters or more is cut by the first append and never changes
    again, so for those it only matters whether any row appends.
    ``n_sessions`` counts distinct sessions (all rows with ``always_append``); the session list
    itself is ``entity_sessions``.
    """
    by = ["container", "name"]
    rows = mentions.withColumn("name", trim_space(F.col("name"))).where(F.col("name") != "")
    rows = rows.withColumn("summary", F.coalesce("summary", F.lit("")))
    first = rows.groupBy(*by).agg(
        F.min_by(F.lower("type"), order).alias("type"),
        F.min(order).alias("_first"),
        (F.count("*") if always_append else F.count_distinct("session_id")).alias("n_sessions"),
    )
    heads = first_row(rows.select(*by, order, "summary"), by, [F.col(order)])
    large = heads.where(F.length("summary") >= most).select(
        *by, F.col(order).alias("_at"), F.col("summary").alias("_text"))
    appends = F.col(order) > F.col("_at")
    if not always_append:
        appends = appends & (F.col("summary") != "") & ~F.col("_text").contains(F.substring("summary", 1, prefix))
    cut = rows.join(large.select(*by, "_at", "_text"), by).groupBy(*by).agg(F.bool_or(appends).alias("_cut"))
    settled = large.join(cut, by).select(
        *by, F.when(F.col("_cut"), F.substring("_text", 1, most)).otherwise(F.col("_text")).alias("summary"))

    short = rows.join(large.select(*by), by, "left_anti").select(
        *by, order, F.substring("summary", 1, most).alias("summary"))
    if always_append:
        kept = top_k(short, by, [F.col(order)], most + 1, "_n", spread=order).drop("_n")
    else:
        distinct = first_row(
            short.withColumn("_prefix", F.substring("summary", 1, prefix)),
            [*by, "_prefix"], [F.col(order)],
        )
        # At most most * prefix different substrings of such a text are skipped, and at most
        # ``most`` rows append, before nothing can change any more.
        bound = most * prefix + most + 1
        kept = top_k(distinct.drop("_prefix"), by, [F.col(order)], bound, "_n", spread=order).drop("_n")

    def append(acc, row):
        text = row["summary"]
        joined = F.substring(F.concat(acc, F.lit(" "), text), 1, most)
        if always_append:
            return joined
        new = (text != "") & ~acc.contains(F.substring(text, 1, prefix))
        return F.when(new, joined).otherwise(acc)

    rows_list = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "summary")))
    folded = (
        kept.groupBy(*by).agg(rows_list.alias("_rows"))
        .select(*by, F.aggregate(
            F.slice("_rows", F.lit(2), F.size("_rows")),
            F.element_at("_rows", 1)["summary"], append).alias("summary"))
    )
    return folded.unionByName(settled).join(first, by).drop("_first")


def entity_sessions(mentions: DataFrame) -> DataFrame:
    """``(container, name, session_id)`` without repeats: the session set of each entity."""
    return (
        mentions.select("container", trim_space(F.col("name")).alias("name"), "session_id")
        .where(F.col("name") != "").distinct()
    )


def dedup_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """First row per (container, source, relation, target)."""
    return first_row(edges, ["container", "source", "relation", "target"], [F.col(order)])


def _dated(edges: DataFrame) -> DataFrame:
    """Edges with a ``date`` column, null where the input has none."""
    return edges if "date" in edges.columns else edges.withColumn("date", F.lit(None).cast("string"))


def match_mentions(queries: DataFrame, entities: DataFrame, mode: str = "ngram") -> DataFrame:
    """``(query_id, container, name)`` for entities a query mentions.

    ``ngram``: the full name, or a name part longer than two characters, occurs at word boundaries.
    Query word sequences are cut at exactly the key lengths that occur, then joined by equality.

    ``like``: some query word longer than two characters is a substring of the name. Name fragments
    are cut at the word lengths that occur, then joined by equality.
    """
    if mode == "ngram":
        keys = (
            entities.select("container", "name", F.explode(name_keys(F.col("name"))).alias("key"))
            .where(F.length("key") > 2)
            .withColumn("_words", word_sequence(F.col("key")))
            .where(F.size("_words") > 0)
            .select("container", "name", F.size("_words").alias("_len"),
                    F.array_join("_words", " ").alias("_gram"))
        )
        # Few rows, and a container may hold most queries: its queries stay where they are.
        lengths = cut_lineage(keys.select("container", "_len").distinct())
        lengths = F.broadcast(lengths) if fits(lengths) else lengths
        grams = (
            queries.select("query_id", "container", word_sequence(F.col("text")).alias("_words"))
            .join(lengths, "container").where(F.size("_words") >= F.col("_len"))
            .select("query_id", "container", F.explode(F.array_distinct(F.transform(
                F.sequence(F.lit(1), F.size("_words") - F.col("_len") + 1),
                lambda i: F.array_join(F.slice(F.col("_words"), i, F.col("_len")), " ")))).alias("_gram"))
        )
        return grams.join(keys, ["container", "_gram"]).select("query_id", "container", "name").distinct()
    if mode != "like":
        raise ValueError(f"unknown mode {mode!r}")
    words = (
        queries.select("query_id", "container", F.explode(F.array_distinct(
            F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word"))
        .where(F.length("word") > 2)
    )
    lengths = words.select("container", F.length("word").alias("_len")).distinct()
    fragments = (
        entities.select("container", "name", F.lower("name").alias("_low")).distinct()
        .join(lengths, "container").where(F.length("_low") >= F.col("_len"))
        .select("container", "name", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("_low") - F.col("_len") + 1),
            lambda i: F.substring(F.col("_low"), i, F.col("_len"))))).alias("word"))
    )
    return words.join(fragments, ["container", "word"]).select("query_id", "container", "name").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: ``(container, node, other, ord, edge)``; a loop appears once.

    A traversal then needs one equi-join per hop instead of an OR condition.
    """
    edges = _dated(edges)
    edge = F.struct("source", "relation", "target", "date")
    out = edges.select("container", F.col("source").alias("node"), F.col("target").alias("other"),
                       "ord", F.lit(0).alias("side"), edge.alias("edge"))
    back = edges.where(F.col("source") != F.col("target")).select(
        "container", F.col("target").alias("node"), F.col("source").alias("other"),
        "ord", F.lit(1).alias("side"), edge.alias("edge"))
    return out.unionByName(back)


def _starts(seeds: DataFrame, entities: DataFrame, require_seed_node: bool) -> DataFrame:
    """``(query_id, container, name, path)`` of the seeds, each once."""
    if require_seed_node:
        seeds = seeds.join(entities.select("container", "name"), ["container", "name"], "left_semi")
    return seeds.groupBy("query_id", "container", "name").agg(F.array(F.min("ord").cast("bigint")).alias("path"))


def _next(here: DataFrame, over: DataFrame, many: bool) -> DataFrame:
    """Rows of the frontier at the links of their nodes; ``many`` spreads links of one node that are not few."""
    at = here.withColumnRenamed("name", "node")
    by = ["container", "node"]
    rows = salted_join(at, over, by, "other") if many else at.join(over, by)
    return rows.withColumn("path", F.concat("path", F.array(F.col("ord").cast("bigint"))))


def khop_nodes(seeds: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2, cap_nodes: int = MAX_ENTITIES,
               require_seed_node: bool = False) -> DataFrame:
    """The entities of ``khop``.

    A query that holds ``cap_nodes`` nodes with a row goes no further, since later hops come after. One that goes on
    holds fewer, so of a node's links to nodes with a row the first ``2 * cap_nodes`` by arrival show all that are new or
    as many as are listed. Links to nodes without a row are followed whole, but for the last hop.
    """
    key = ["query_id", "container"]
    known = entities.select("container", F.col("name").alias("other")).distinct().withColumn("has", F.lit(True))
    ends = adjacency(edges).groupBy("container", "node", "other").agg(F.min("ord").alias("ord")).join(
        known, ["container", "other"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    ends = cut_lineage(ends)
    near = top_k(ends.where("has"), ["container", "node"], [F.col("ord"), F.col("other")], 2 * cap_nodes, "_n",
                 spread="other").drop("_n")
    bare = ends.where(~F.col("has"))
    frontier = _starts(seeds, entities, require_seed_node).join(
        known.withColumnRenamed("other", "name"), ["container", "name"], "left").select(
        *key, "name", "path", F.coalesce("has", F.lit(False)).alias("has"), F.lit(0).alias("hop"))
    frontier = visited = cut_lineage(frontier)
    for hop in range(1, hops + 1):
        done = visited.where("has").groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= cap_nodes)
        here = frontier.join(done.select(*key), key, "left_anti").select(*key, "name", "path")
        reached = _next(here, near, 2 * cap_nodes > WINDOW_LIMIT)
        if hop < hops:
            reached = reached.unionByName(_next(here, bare, True))
        frontier = cut_lineage(
            reached.groupBy(*key, F.col("other").alias("name"), "has").agg(F.min("path").alias("path"))
            .join(visited.select(*key, "name"), [*key, "name"], "left_anti")
            .select(*key, "name", "path", "has", F.lit(hop).alias("hop")))
        visited = visited.unionByName(frontier)
    # Cut before the rows are met, too: no query lists more than its first nodes.
    order = [F.col("hop"), F.col("path")]
    first = top_k(visited.where("has").drop("has"), key, [*order, F.col("name")], cap_nodes, "_n", spread="name").drop("_n")
    nodes = first.join(entities.select("container", "name", "type", "summary"), ["container", "name"])
    return top_k(nodes, key, order, cap_nodes, "pos").drop("path")


def khop_edges(seeds: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2, cap_edges: int = MAX_EDGES,
               require_seed_node: bool = False) -> DataFrame:
    """The relationships of ``khop``.

    An edge is crossed once from each end at most, so a query's first ``2 * cap_edges`` crossings hold its first
    ``cap_edges`` edges, no node adds more than its own first ``2 * cap_edges``, and a query that has crossed
    ``cap_edges`` edges goes no further. One that goes on has crossed all links of its nodes.
    """
    key = ["query_id", "container"]
    most = 2 * cap_edges
    listed = cut_lineage(top_k(adjacency(dedup_edges(edges)), ["container", "node"],
                               [F.col("ord"), F.col("side"), F.col("edge")], most, "_n", spread="other"))
    degree = listed.groupBy("container", F.col("node").alias("name")).agg(F.count("*").alias("_deg"))
    frontier = visited = cut_lineage(_starts(seeds, entities, require_seed_node))
    crossed = None
    per_query = Window.partitionBy(*key)
    for hop in range(1, hops + 1):
        # Crossings follow the paths of their nodes: those of nodes after the first ``most`` crossings are not wanted.
        here = frontier.join(degree, ["container", "name"]).withColumn(
            "_before", F.sum("_deg").over(per_query.orderBy("path").rangeBetween(Window.unboundedPreceding, Window.currentRow))
            - F.sum("_deg").over(Window.partitionBy(*key, "path"))).where(F.col("_before") < most).drop("_deg")
        step = _next(here, listed, most > WINDOW_LIMIT).where(F.col("_n") <= most - F.col("_before"))
        step = cut_lineage(step.select(*key, "edge", "path", "other", F.lit(hop).alias("hop")))
        crossed = step if crossed is None else crossed.unionByName(step)
        if hop < hops:
            done = crossed.select(*key, "edge").distinct().groupBy(*key).agg(F.count("*").alias("_n")).where(
                F.col("_n") >= cap_edges)
            frontier = cut_lineage(
                step.join(done.select(*key), key, "left_anti")
                .groupBy(*key, F.col("other").alias("name")).agg(F.min("path").alias("path"))
                .join(visited.select(*key, "name"), [*key, "name"], "left_anti"))
            visited = visited.unionByName(frontier)
    order = [F.col("hop"), F.col("path")]
    crossed = top_k(crossed.drop("other"), key, order, most, "_n", spread="edge").drop("_n")
    once = crossed.groupBy(*key, "edge").agg(F.min(F.struct("hop", "path")).alias("_at"))
    once = once.select(*key, "edge", F.col("_at.hop").alias("hop"), F.col("_at.path").alias("path"))
    rels = top_k(once, key, order, cap_edges, "pos")
    return rels.select(*key, "edge.source", "edge.relation", "edge.target", "edge.date", "hop", "pos")


def khop(seeds: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2,
         cap_nodes: int = MAX_ENTITIES, cap_edges: int = MAX_EDGES,
         require_seed_node: bool = False) -> tuple[DataFrame, DataFrame]:
    """Undirected ``hops``-step surroundings of the seeds ``(query_id, container, name, ord)``.

    Returns (entities, relationships) per query in discovery order, cut at the caps; the result is that of the whole
    traversal. Seeds without a node row still expand unless ``require_seed_node``.
    Discovery order is the path of arrival numbers from the seed, compared element by element.
    """
    return (khop_nodes(seeds, edges, entities, hops, cap_nodes, require_seed_node),
            khop_edges(seeds, edges, entities, hops, cap_edges, require_seed_node))


def khop_edge_counts(seeds: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2,
                     require_seed_node: bool = False) -> DataFrame:
    """``(query_id, container, n)``: the number of edges that ``khop`` without caps returns.

    These are the edges at the nodes reached before the last hop: the sum of their degrees, less the edges with both ends
    among them, which it counts twice. The last hop is not taken. Each edge is looked for from its end of lower degree only, so
    a node with many links is not expanded for that.
    """
    key = ["query_id", "container"]
    links = cut_lineage(adjacency(dedup_edges(edges)).select("container", "node", "other", "ord", "edge"))
    # A pair joined by several relations is one row with their number.
    pairs = links.groupBy("container", "node", "other").agg(F.count("*").alias("_links"), F.min("ord").alias("ord"))
    degree = cut_lineage(links.groupBy("container", F.col("node").alias("name")).agg(F.count("*").alias("_deg")))
    frontier = visited = cut_lineage(_starts(seeds, entities, require_seed_node))
    for _ in range(1, hops):
        frontier = cut_lineage(
            _next(frontier, pairs, True).groupBy(*key, F.col("other").alias("name")).agg(F.min("path").alias("path"))
            .join(visited.select(*key, "name"), [*key, "name"], "left_anti"))
        visited = visited.unionByName(frontier)
    inside = cut_lineage(visited.select(*key, "name").join(degree, ["container", "name"]))
    far = degree.select("container", F.col("name").alias("other"), F.col("_deg").alias("_far"))
    lower = pairs.where("node <> other").join(degree.withColumnRenamed("name", "node"), ["container", "node"]).join(
        far, ["container", "other"]).where(
        (F.col("_deg") < F.col("_far")) | ((F.col("_deg") == F.col("_far")) & (F.col("node") < F.col("other"))))
    twice = inside.select(*key, F.col("name").alias("node")).join(
        lower.select("container", "node", "other", "_links"), ["container", "node"]).join(
        inside.select(*key, F.col("name").alias("other")), [*key, "other"])
    signed = inside.select(*key, F.col("_deg").alias("_c")).unionByName(twice.select(*key, (-F.col("_links")).alias("_c")))
    return signed.groupBy(*key).agg(F.sum("_c").alias("n"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Outgoing, then incoming neighbours of every node, numbered per node; loops appear twice."""
    out = edges.select("container", F.col("source").alias("node"), F.col("target").alias("other"),
                       F.lit(0).alias("side"), "ord", "source", "relation", "target")
    back = edges.select("container", F.col("target").alias("node"), F.col("source").alias("other"),
                        F.lit(1).alias("side"), "ord", "source", "relation", "target")
    return out.unionByName(back)


def deep_bfs(seeds: DataFrame, edges: DataFrame, hops: int = 2, neighbour_cap: int = NEIGHBOUR_CAP,
             stop_at: int = RELATION_STOP) -> tuple[DataFrame, DataFrame]:
    """Queue-order traversal that also expands nodes at the last depth.

    A node contributes its first ``neighbour_cap`` neighbours; a query stops before the node at
    which it already holds ``stop_at`` relationship rows. Nodes past that point are dropped at each
    depth, so a query never carries more than ``stop_at`` expanding nodes. Returns (entities,
    relationships) in order, without repeats; seeds are listed only if reached again.
    """
    key = ["query_id", "container"]
    keyed = edges.select("container", graph_key(F.col("source")).alias("source"), "relation",
                         graph_key(F.col("target")).alias("target"), "ord")
    order = [F.col(c) for c in ("side", "ord", "source", "relation", "target")]
    around = top_k(neighbours(keyed), ["container", "node"], order, neighbour_cap, "n")
    degree = around.groupBy("container", "node").agg(F.count("*").alias("deg"))

    frontier = seeds.select(*key, graph_key(F.col("name")).alias("node"), F.col("ord").cast("bigint"))
    frontier = frontier.groupBy(*key, "node").agg(F.array(F.min("ord")).alias("path"))
    visited, reached = None, None
    used = seeds.select(*key).distinct().withColumn("_used", F.lit(0).cast("bigint"))
    for depth in range(hops + 1):
        so_far = Window.partitionBy(*key).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        # The stop drops a suffix of the queue; nodes before it number at most stop_at.
        queue = (
            frontier.join(degree, ["container", "node"])
            .join(used, key)
            .withColumn("_before", F.col("_used") + F.coalesce(F.sum("deg").over(so_far), F.lit(0)))
            .where(F.col("_before") < stop_at)
        )
        found = queue.select(*key, "node", "path").join(around, ["container", "node"]).withColumn(
            "path", F.concat("path", F.array(F.col("n").cast("bigint")))
        ).withColumn("depth", F.lit(depth))
        reached = found if reached is None else reached.unionByName(found)
        spent = queue.groupBy(*key).agg(F.sum("deg").alias("_more"))
        used = used.join(spent, key, "left").select(
            *key, (F.col("_used") + F.coalesce("_more", F.lit(0))).alias("_used"))
        here = frontier.select(*key, "node")
        visited = here if visited is None else visited.unionByName(here)
        if depth < hops:
            frontier = (
                found.groupBy(*key, F.col("other").alias("node")).agg(F.min("path").alias("path"))
                .join(visited, [*key, "node"], "left_anti")
            )
    at = F.min(F.struct("depth", "path")).alias("_at")
    position = F.row_number().over(Window.partitionBy(*key).orderBy("_at"))
    entities = reached.groupBy(*key, F.col("other").alias("name")).agg(at)
    rels = reached.groupBy(*key, "source", "relation", "target").agg(at)
    return (
        entities.withColumn("pos", position).drop("_at"),
        rels.withColumn("pos", position).drop("_at"),
    )


def deep_seeds(queries: DataFrame, relations: DataFrame) -> DataFrame:
    """Seed nodes from retrieved relations ``(query_id, container, source, target, ord)``.

    Names that hold a query term longer than two characters; a query without any takes the first
    non-empty name.
    """
    key = ["query_id", "container"]
    names = relations.select(*key, "ord", F.posexplode(F.array("source", "target")).alias("side", "_name"))
    names = names.select(*key, "ord", "side", graph_key(F.coalesce("_name", F.lit(""))).alias("name")).where(
        F.col("name") != ""
    )
    terms = queries.select(*key, F.filter(
        F.transform(F.split("text", r"\s+"), lambda t: F.lower(t)), lambda t: F.length(t) > 2).alias("_terms"))
    tagged = names.join(terms, key).withColumn(
        "_hit", F.exists("_terms", lambda t: F.col("name").contains(t))
    )
    hits = tagged.where("_hit").groupBy(*key, "name").agg(F.min(F.struct("ord", "side")).alias("_at"))
    hits = hits.select(*key, "name", F.col("_at.ord").alias("ord"))
    lone = first_row(names, key, [F.col("ord"), F.col("side")]).select(*key, "name", "ord")
    return hits.unionByName(lone.join(hits.select(*key).distinct(), key, "left_anti"))


def graph_context(queries: DataFrame, entities: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Mentions, their surroundings and both as tagged result rows with score 0."""
    found = match_mentions(queries, entities).withColumn(
        "ord", F.row_number().over(Window.partitionBy("query_id", "container").orderBy("name"))
    )
    nodes, rels = khop(found, edges, entities, hops)
    node_rows = nodes.select(
        "query_id", "container", F.lit("entity").alias("row_type"), "name",
        F.col("type").alias("entity_type"), F.col("summary").alias("content"), "pos",
    )
    rel_rows = rels.select(
        "query_id", "container", F.lit("relationship").alias("row_type"), "source", "relation", "target", "date",
        F.concat_ws(" ", "source", "relation", "target").alias("content"), "pos",
    )
    return node_rows.unionByName(rel_rows, allowMissingColumns=True).withColumn("score", F.lit(0.0))
