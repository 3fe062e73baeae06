"""Communities of claims."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.exchange import hot_keys, key_counts, lookup_join, number_rows
from riskloom.operators.components import components
from riskloom.session import discard, materialize, written_only


def shared_location_communities(occ: DataFrame) -> DataFrame:
    """Rows `community_id, size, claim_id` of the shared-location graph.

    Claims at one location form a clique and have no other edges, so the communities of
    highest modularity are the locations with two claims or more. Ids follow size, then
    smallest claim id. Members are rows, not arrays, as one location may hold a large
    part of all claims.
    """
    groups = materialize(
        occ.groupBy("location_key").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first")), "locations"
    )
    shared = groups.where("n > 1").withColumn("order", -F.col("n"))
    numbered = number_rows(shared, [F.col("order"), F.col("first")], "community_id").select(
        "location_key", "community_id", F.col("n").alias("size")
    )
    members = occ.select("claim_id", "location_key")
    joined = lookup_join(members, numbered, "location_key", "claim_id", hot_keys(groups, "location_key"), "inner")
    return joined.select(F.col("community_id").cast("long").alias("community_id"), "size", "claim_id")


def community_summary(communities: DataFrame, edge_count: DataFrame, top: int = 10) -> DataFrame:
    """Rows `metric, community_id, value`: node, edge and community counts, and the sizes
    of the largest communities. `edge_count` is a one-row table with column `n`."""
    sizes = communities.groupBy("community_id").agg(F.count(F.lit(1)).alias("value"))
    nobody = F.lit(None).cast("long")
    totals = sizes.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("communities"))
    counts = totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("graph_nodes").alias("metric"), nobody.alias("community_id"), F.col("nodes").alias("value")),
                F.struct(
                    F.lit("community_count").alias("metric"), nobody.alias("community_id"), F.col("communities").alias("value")
                ),
            )
        )
    )
    edges = edge_count.select(F.lit("graph_edges").alias("metric"), nobody.alias("community_id"), F.col("n").alias("value"))
    largest = sizes.orderBy(F.desc("value"), "community_id").limit(top)
    return counts.unionByName(edges).unionByName(largest.select(F.lit("largest").alias("metric"), "community_id", "value"))


def _degrees(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.sum("w").alias("k"))


# With less than this share of the nodes beside another community, a round reads the links of
# these nodes and of those that a move may have added, not all links.
RESTRICT_BELOW = 0.125


def _moves(
    links: DataFrame, state: DataFrame, totals: DataFrame, hubs: DataFrame | None, twice_total: float, resolution: float, turn: int
) -> DataFrame:
    """One round of local moving: the nodes whose turn it is go to the neighbouring
    community of greatest gain, the smallest id among equals, if that beats staying.

    Rows `node, community, next, wants` of the nodes of `links` with a neighbour in another
    community; no other node can want to move. `hubs` are the nodes with very many links. A
    community may grow as large: joins on communities are salted by its members, or by its
    links, which bound its neighbours.
    """
    crowded = hot_keys(totals.select("community", F.col("members").alias("n")), "community")
    popular = hot_keys(totals.select(F.col("community").alias("to"), F.col("total").alias("n")), "to")

    neighbour = state.select(F.col("node").alias("b"), F.col("community").alias("to"))
    # Weight from each node to each adjacent community; self-loops move with their node.
    weights = (
        lookup_join(links.where("a <> b"), neighbour, "b", "a", hubs, "inner")
        .groupBy("a", "to")
        .agg(F.sum("w").alias("w"))
    )
    placed = state.select(F.col("node").alias("a"), "community", "k")
    options = materialize(lookup_join(weights, placed, "a", "to", _renamed(hubs, "b", "a"), "inner"), "options")
    target = totals.select(F.col("community").alias("to"), "total", "members")
    own = totals.select("community", F.col("total").alias("own_total"), F.col("members").alias("own_members"))
    leaving = lookup_join(options.where("to <> community"), target, "to", "a", popular, "inner")
    leaving = lookup_join(leaving, own, "community", "a", crowded, "inner")
    pull = F.col("w") - resolution * F.col("k") * F.col("total") / twice_total
    # Two lone nodes must not swap places: only the one with the greater id moves.
    swap = (F.col("own_members") == 1) & (F.col("members") == 1) & (F.col("to") > F.col("community"))
    best = leaving.groupBy("a").agg(
        F.first("community").alias("community"),
        F.first("k").alias("k"),
        F.first("own_total").alias("own_total"),
        F.min(F.when(~swap, F.struct((-pull).alias("cost"), F.col("to")))).alias("best"),
    )
    stays = options.where("to = community").select("a", F.col("w").alias("own_w"))
    alone = -resolution * F.col("k") * (F.col("own_total") - F.col("k")) / twice_total
    stay_pull = F.col("own_w") - resolution * F.col("k") * (F.col("own_total") - F.col("k")) / twice_total
    joined = best.join(stays, "a", "left")
    gain = -F.col("best.cost") - F.coalesce(stay_pull, alone)
    moving = (gain > 1e-12) & (F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0)
    return joined.select(
        F.col("a").alias("node"),
        "community",
        F.when(moving, F.col("best.to")).otherwise(F.col("community")).alias("next"),
        (F.coalesce(gain, F.lit(0.0)) > 1e-12).alias("wants"),
    )


def _totals(state: DataFrame) -> DataFrame:
    """Weight and members of each community, written."""
    return materialize(state.groupBy("community").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("members")), "totals")


def _affected(links: DataFrame, judged: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Rows `a`: the nodes that can have a neighbour in another community, after a round in
    which those in `judged` had one: these, and the neighbours of those that moved."""
    moved = judged.where("next <> community").select(F.col("node").alias("b"))
    around = lookup_join(links.select("a", "b"), moved, "b", "a", hubs, "inner").select("a")
    return around.unionAll(judged.select(F.col("node").alias("a"))).distinct()


def _renamed(hot: DataFrame | None, old: str, new: str) -> DataFrame | None:
    return None if hot is None else hot.withColumnRenamed(old, new)


def _named_by_first(table: DataFrame) -> DataFrame:
    """Rows `node, community` with each community named by its smallest node."""
    names = materialize(
        table.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("_name")), "names"
    )
    named = lookup_join(
        table.select("node", "community"), names.drop("n"), "community", "node", hot_keys(names, "community"), "inner"
    )
    return named.select("node", F.col("_name").alias("community"))


def _undirected(edges: DataFrame) -> DataFrame:
    """Each pair of nodes that an edge joins, once."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _inside(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with the communities of their ends, `ca` and `cb`; hubs are salted."""
    a = members.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    b = members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    with_a = lookup_join(pairs, a, "a", "b", hot_keys(key_counts(pairs, "a"), "a"), "inner")
    return lookup_join(with_a, b, "b", "a", hot_keys(key_counts(pairs, "b"), "b"), "inner")


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row `modularity`: the share of edges within communities, less what it would be
    if edges were dealt by degree. By counts per community; zero without edges."""
    placed = _inside(_undirected(edges), members)
    ends = placed.select(F.inline(F.array(F.struct(F.col("ca").alias("c")), F.struct(F.col("cb").alias("c")))), (F.col("ca") == F.col("cb")).cast("long").alias("within"))
    counts = ends.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.sum("within").alias("w"))
    total = F.sum("k").cast("double")
    share = F.try_divide(F.sum("w"), total) - resolution * F.try_divide(F.sum(F.col("k").cast("double") * F.col("k")), total * total)
    return counts.agg(F.coalesce(share, F.lit(0.0)).alias("modularity"))


def connected_parts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Rows `node, community` with every community split into its connected parts, each
    named by its smallest node. A split never lowers modularity."""
    within = _inside(_undirected(edges), members).where("ca = cb")
    roots = written_only(lambda: components(within.select("a", "b")), "parts")
    return members.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("community"))


def louvain(
    edges: DataFrame, resolution: float = 1.0, max_turns: int = 1000, max_levels: int = 100
) -> DataFrame:
    """Communities of an undirected edge table `src, dst`: rows `node, community`, named
    by their smallest node. Unweighted modularity, deterministic.

    Rounds of local moving are joins and aggregations over all nodes at once; a hash
    of node and round picks the half that may move, so that neighbours do not chase
    each other. Each round is written to the shared folder, which ends its lineage.
    When no node wants to move, communities become nodes and the next level starts. Once few
    nodes lie beside another community, a round reads the links of these only; the others
    would stay, so the moves are the same.

    Nodes that move at the same time can make a level worse, and can leave a community in
    pieces. So levels go on only while modularity, counted anew after each, rises, and
    the best partition is taken; at the end every community is split into its connected
    parts. A level that takes more than `max_turns` rounds, or more than `max_levels`
    levels, are an error.
    """
    pairs = _undirected(edges)
    both = pairs.select("a", "b", F.lit(1.0).alias("w")).unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1.0).alias("w")))
    links = materialize(both, "links")
    own = materialize(links.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")), "pairs")
    members = materialize(links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")), "members")
    twice_total = links.agg(F.sum("w")).first()[0]
    if not twice_total:
        return members
    best = modularity(own, members, resolution).first()[0]

    for level in itertools.count():
        if level == max_levels:
            raise RuntimeError(f"communities still change after {max_levels} levels")
        state = materialize(_degrees(links).select(F.col("a").alias("node"), F.col("a").alias("community"), "k"), "state")
        hubs = hot_keys(key_counts(links, "b"), "b")
        ends = _renamed(hubs, "b", "a")  # links are symmetric
        nodes, totals, near = state.count(), _totals(state), links
        changed = False
        for turn in itertools.count():
            if turn == max_turns:
                raise RuntimeError(f"nodes still move after {max_turns} rounds of level {level}")
            judged = written_only(lambda: _moves(near, state, totals, hubs, twice_total, resolution, turn), "judged")  # noqa: B023
            if near is not links:
                discard(near)
            discard(totals)
            found = judged.agg(F.count(F.lit(1)).alias("rows"), F.count_if("wants").alias("wanting")).first()
            if not found["wanting"]:
                discard(judged)
                break
            changed = True
            step = judged.where("next <> community").select("node", "next")
            old, state = state, materialize(state.join(step, "node", "left").select("node", F.coalesce("next", "community").alias("community"), "k"), "state")
            discard(old)
            totals, near = _totals(state), links
            if found["rows"] < nodes * RESTRICT_BELOW:
                affected = materialize(_affected(links, judged, hubs), "affected")
                near = materialize(lookup_join(links, affected, "a", "b", ends, "inner"), "near")
                discard(affected)
            discard(judged)
        if not changed:
            break
        renamed = written_only(lambda: _named_by_first(state), "renamed")  # noqa: B023
        discard(state)
        following = renamed.select(F.col("node").alias("community"), F.col("community").alias("_next"))
        hot = hot_keys(key_counts(members, "community"), "community")
        now = lookup_join(members, following, "community", "node", hot, "inner").select("node", F.col("_next").alias("community"))
        now = materialize(now, "members")
        reached = modularity(own, now, resolution).first()[0]
        if reached <= best + 1e-12:
            break
        best, old, members = reached, members, now
        discard(old)
        group_a = renamed.select(F.col("node").alias("a"), F.col("community").alias("ca"))
        group_b = renamed.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        joined = lookup_join(lookup_join(links, group_a, "a", "b", ends, "inner"), group_b, "b", "a", hubs, "inner")
        old, links = links, materialize(joined.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "links")
        discard(old, renamed)
    return connected_parts(own, members)


def rank_communities(members: DataFrame) -> DataFrame:
    """Rows `community_id, size, claim_id` from `node, community`, ids by size."""
    members = materialize(members, "members")
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    numbered = number_rows(sizes.withColumn("order", -F.col("n")), [F.col("order"), F.col("first")], "community_id")
    ids = numbered.select("community", "community_id", F.col("n").alias("size"))
    joined = lookup_join(members, ids, "community", "node", hot_keys(numbered, "community"), "inner")
    return joined.select(F.col("community_id").cast("long").alias("community_id"), "size", F.col("node").alias("claim_id"))
