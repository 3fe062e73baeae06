import itertools
import random

import pytest

import riskloom.exchange as exchange
from riskloom.operators import communities as c
from riskloom.operators import graph as g

COLUMNS = "claim_id string, incident_state string, incident_city string"


def at(spark, sizes):
    """Claims at locations of the given sizes, and one claim without a location."""
    rows = [(f"c{i:02d}_{j:03d}", "OH", f"city{i}") for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame([*rows, ("lost", None, None)], COLUMNS)


def groups(sizes):
    return [[f"c{i:02d}_{j:03d}" for j in range(n)] for i, n in enumerate(sizes)]


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_links(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(exchange, "HOT_ROWS", hot)
    sizes = [1, 2, 17, 5]
    got = rows(g.shared_location_links(g.occurrences(at(spark, sizes))))
    assert got == sorted(((x[0], y, len(x) * (len(x) - 1) // 2) for x in groups(sizes) for y in x[1:]), key=repr)
    assert g.shared_pair_total(g.occurrences(at(spark, sizes))).first()["n"] == sum({r[0]: r[2] for r in got}.values())


def clique_edges(spark, sizes):
    pairs = [p for group in groups(sizes) for p in itertools.combinations(group, 2)]
    return spark.createDataFrame(pairs, "src string, dst string")


def test_louvain_says_when_it_is_not_done(spark):
    with pytest.raises(RuntimeError, match="still"):
        c.louvain(clique_edges(spark, [4, 3]), max_turns=1)


@pytest.mark.parametrize("hot", [1_000_000, 4])
def test_related_claims_are_capped(spark, monkeypatch, hot):
    monkeypatch.setattr(exchange, "HOT_ROWS", hot)
    sizes = [14, 11, 1, 3]
    got = {r["claim_id"]: r for r in g.related_claims(g.occurrences(at(spark, sizes))).collect()}
    for group in groups(sizes):
        for claim in group:
            others = [x for x in group if x != claim][:10]
            assert got[claim]["related_claim_ids"] == others and got[claim]["related_count"] == len(others)


def test_related_claims_of_some(spark):
    from riskloom.operators.normalize import with_location

    claims = with_location(at(spark, [4, 2]))
    some = claims.where("claim_id in ('c00_001', 'lost')")
    got = {r["claim_id"]: r["related_claim_ids"] for r in g.related_claims(g.occurrences(at(spark, [4, 2])), some).collect()}
    assert got == {"c00_001": ["c00_000", "c00_002", "c00_003"], "lost": []}


def test_split_safe_features(spark, rows, monkeypatch):
    data = [
        ("a", "train", "OH", "x", "T1"), ("b", "train", "OH", "x", "T1"), ("c", "test", "OH", "x", "T2"),
        ("d", "train", "OH", "y", None), ("e", "validation", "OH", "z", "T3"), ("f", "train", None, None, "T1"),
    ]
    claims = spark.createDataFrame(data, "claim_id string, split string, incident_state string, incident_city string, claim_type string")
    location = [
        ("a", "train", 2, 1), ("b", "train", 2, 1), ("c", "test", 2, 2), ("d", "train", 1, 0), ("e", "validation", 0, 0), ("f", "train", 0, 0),
    ]
    assert rows(g.split_safe_location_features(claims)) == location
    monkeypatch.setattr(exchange, "HOT_ROWS", 1)
    assert rows(g.split_safe_location_features(claims)) == location
    full = claims.selectExpr("*", "'same' AS collision_type", "'s' AS incident_severity")
    for limit in [exchange.BROADCAST_BYTES, 0]:
        monkeypatch.setattr(exchange, "BROADCAST_BYTES", limit)
        got = {r["claim_id"]: tuple(r)[2:] for r in g.split_safe_attribute_features(full).collect()}
        assert got == {"a": (2, 3, 3, 2), "b": (2, 3, 3, 2), "c": (0, 4, 4, 3), "d": (0, 3, 3, 2), "e": (0, 4, 4, 3), "f": (2, 3, 3, 0)}


def test_whole_graph_features(spark):
    got = {r["claim_id"]: r["location_claim_count"] for r in g.location_features(at(spark, [3, 1])).collect()}
    assert got == {"c00_000": 2, "c00_001": 2, "c00_002": 2, "c01_000": 0, "lost": 0}


def test_claims_without_policy_are_no_nodes(spark):
    edges = g.drop_obsolete(spark.createDataFrame([("a", "b", "SHARES_SEVERITY"), ("a", "b", "HAS_SEVERITY")], "src string, dst string, rel_type string"))
    assert [r["rel_type"] for r in edges.collect()] == ["HAS_SEVERITY"]
    claims = spark.createDataFrame([("CLM_1", "1"), ("CLM_2", "2")], "claim_id string, policy_id string")
    policies = spark.createDataFrame([("1",)], "policy_id string")
    assert [tuple(r) for r in g.has_claim_edges(claims, policies).collect()] == [("1", "CLM_1", "HAS_CLAIM")]


def test_nodes_and_edges_are_read_from_claims_joined_once(spark, rows):
    names = "claim_date claim_type claim_description claimed_amount approved_amount status fraud_label incident_date collision_type incident_severity authorities_contacted"
    names += " incident_state incident_city incident_hour_of_the_day number_of_vehicles_involved bodily_injuries witnesses police_report_available total_claim_amount"
    claims = spark.createDataFrame([("CLM_1", "1"), ("CLM_2", "2"), ("CLM_3", None)], "claim_id string, policy_id string").selectExpr("*", *[f"'{c}' AS {c}" for c in names.split()])
    terms = "policy_type policy_start_date policy_end_date premium deductible coverage_amount status"
    policies = spark.createDataFrame([("1",), ("1",), (None,)], "policy_id string").selectExpr("*", *[f"'{c}' AS {c}" for c in terms.split()])
    nodes, edges = g.property_nodes(policies, claims), g.linear_edges(policies, claims)
    assert [r["node_id"] for r in nodes["Claim"].collect()] == ["CLM_1"] and nodes["IncidentLocation"].count() == 1
    assert sorted(r["rel_type"] for r in edges.collect()) == sorted(["HAS_CLAIM", "OCCURRED_AT", *[rel for _, rel, _, _ in g.ATTRIBUTE_RELATIONS]])
    for table in (*nodes.values(), edges):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_communities_of_cliques(spark, rows):
    occ = g.occurrences(at(spark, [4, 1, 6, 2, 4]))
    found = c.shared_location_communities(occ)
    ids = {r["claim_id"]: r["community_id"] for r in found.collect()}
    assert (ids["c02_000"], ids["c00_000"], ids["c04_000"], ids["c03_000"]) == (0, 1, 2, 3) and "lost" not in ids
    assert rows(c.rank_communities(c.louvain(clique_edges(spark, [4, 1, 6, 2, 4])))) == rows(found)


def modularity(edges, of):
    m = len(edges)
    degree = {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(of[a] == of[b] for a, b in edges) / m
    totals = {}
    for node, k in degree.items():
        totals[of[node]] = totals.get(of[node], 0) + k
    return inside - sum((t / (2 * m)) ** 2 for t in totals.values())


def test_louvain_on_linked_cliques(spark, monkeypatch):
    """A ring of cliques, each linked to the next by one edge; a hub in the salted run."""
    cliques = [[f"{k}{i}" for i in range(5)] for k in "abcd"]
    edges = [p for group in cliques for p in itertools.combinations(group, 2)]
    edges += [(cliques[i][0], cliques[(i + 1) % 4][1]) for i in range(4)]
    table = spark.createDataFrame(edges + [(b, a) for a, b in edges[:7]], "src string, dst string")
    found = {r["node"]: r["community"] for r in c.louvain(table).collect()}
    assert found == {n: group[0] for group in cliques for n in group}
    monkeypatch.setattr(exchange, "HOT_ROWS", 4)
    assert {r["node"]: r["community"] for r in c.louvain(table).collect()} == found


def test_louvain_improves_on_random_graph(spark):
    import random

    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    table = spark.createDataFrame(edges, "src long, dst long")
    found = {r["node"]: r["community"] for r in c.louvain(table).collect()}
    assert set(found) == {n for e in edges for n in e}
    assert modularity(edges, found) > 0.3
    again = {r["node"]: r["community"] for r in c.louvain(table.repartition(7)).collect()}
    assert again == found


def test_louvain_without_edges(spark):
    assert c.louvain(spark.createDataFrame([("a", "a")], "src string, dst string")).collect() == []


def test_modularity_and_connected_parts(spark):
    """Against a plain count; a community in two pieces is split, which is no worse."""
    import random

    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)})
    table = spark.createDataFrame(edges + [(b, a) for a, b in edges[:9]] + [(1, 1)], "src long, dst long")
    of = {n: n % 4 for e in edges for n in e}
    members = spark.createDataFrame(sorted(of.items()), "node long, community long")
    before = c.modularity(table, members).first()[0]
    assert abs(before - modularity(edges, of)) < 1e-12
    parts = {r["node"]: r["community"] for r in c.connected_parts(table, members).collect()}
    root = {n: n for n in of}
    for _ in of:
        for a, b in edges:
            if of[a] == of[b]:
                root[a] = root[b] = min(root[a], root[b])
    assert parts == root and modularity(edges, parts) >= before
    assert c.modularity(table.where("false"), members).first()[0] == 0


def test_louvain_rounds_read_few_links(spark, monkeypatch):
    """Rounds that read the links of nodes beside another community only make the same moves
    as rounds that read all."""
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(8)} | {(i, 100 + 40 * i + j) for i in range(2) for j in range(10)}
    table = spark.createDataFrame([(f"n{a:04}", f"n{b:04}") for a, b in pairs], "src string, dst string")
    moves, read = c._moves, []

    def counted(links, *rest):
        read.append(links.count())
        return moves(links, *rest)

    monkeypatch.setattr(c, "_moves", counted)
    found = []
    for share in (0.0, 2.0):
        monkeypatch.setattr(c, "RESTRICT_BELOW", share)
        read.clear()
        found.append((sorted(map(tuple, c.louvain(table).collect())), list(read)))
    (whole, all_links), (restricted, few_links) = found
    assert restricted == whole and len(few_links) == len(all_links)
    assert all(few <= many for few, many in zip(few_links, all_links, strict=True)) and sum(few_links) < sum(all_links)


def test_components_end_when_all_links_lead_to_roots(spark, monkeypatch):
    """Stars take one round of two written tables, and no round that only confirms."""
    from riskloom.operators import components

    written, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: written.append(label) or write(df, label))
    links = spark.createDataFrame([(f"c{k:02}", f"at{k % 3}") for k in range(30)], "a string, b string")
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert found == {f"c{k:02}": f"at{k % 3}" for k in range(30)} | {f"at{k}": f"at{k}" for k in range(3)}
    assert len(written) <= 3
    path = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(60, 60)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(path).collect()} == dict.fromkeys(range(51), 0)
    assert components.components(path.where("false")).count() == 0
