"""Queries over the claim graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.fixed import ATTRIBUTE_FEATURES, LOCATION_FEATURES
from riskloom.operators import communities, graph, split, training
from riskloom.plans import fixtures as fx
from riskloom.plans.oracle import with_ctes
from riskloom.plans.registry import REGISTRY
from riskloom.plans.tables import _counts_sql

add = REGISTRY.add


def occ(s, d):
    return graph.occurrences(fx.claims_table(s, d, "claim_id", "incident_state", "incident_city"))


def wanted(s, d):
    """An id for every line item's order and one, which no claim has, for its supplier."""
    lines = fx.table(s, d, "lineitem")
    order = F.concat(F.lit("CLM_POL"), (F.col("l_orderkey") + 100000).cast("string"))
    none = F.concat(F.lit("CLM_NONE"), F.col("l_suppkey").cast("string"))
    return lines.select(order.alias("claim_id")).unionAll(lines.select(none.alias("claim_id")))


_wanted_sql = """(SELECT DISTINCT claim_id FROM (SELECT 'CLM_POL' || (l_orderkey + 100000) AS claim_id FROM lineitem
  UNION ALL SELECT 'CLM_NONE' || l_suppkey FROM lineitem))"""


def find_graph_features(s, d):
    features = graph.split_safe_location_features(fx.split_table(s, d, "incident_state", "incident_city"))
    splits = [features.where(F.col("split") == name) for name in ["train", "validation", "test"]]
    return training.find_graph_features(splits, wanted(s, d))


def graph_counts(s, d):
    policies, claims = fx.policies_table(s, d), fx.claims_table(s, d)
    linear = graph.graph_counts(graph.all_nodes(policies, claims), graph.linear_edges(policies, claims))
    shared = graph.shared_pair_total(graph.occurrences(claims))
    return linear.unionByName(
        shared.select(F.lit("edge").alias("kind"), F.lit("SHARES_LOCATION_WITH").alias("name"), "n")
    )


def feature_ranges(s, d):
    claims = fx.split_table(
        s, d, "claim_type", "collision_type", "incident_severity", "incident_state", "incident_city"
    )
    joined = graph.split_safe_location_features(claims).join(
        graph.split_safe_attribute_features(claims).drop("split"), "claim_id"
    )
    return graph.feature_ranges(joined, LOCATION_FEATURES + ATTRIBUTE_FEATURES)


def train_claims(s, d):
    """Once by the split column, once by a table of ids."""
    claims = fx.split_table(s, d, "policy_id").select("claim_id", "split")
    ids = split.training_rows(claims).select("claim_id")
    by_ids = split.restrict(fx.claims(s, d), ids).select("claim_id").withColumn("via", F.lit("ids"))
    return ids.withColumn("via", F.lit("column")).unionByName(by_ids)


def louvain(s, d):
    """Communities of claims and their locations, over the edges between them (linear in
    the claims): the claims of each, where it has more than one."""
    located = occ(s, d)
    found = communities.louvain(located.select(F.col("claim_id").alias("src"), F.col("location_key").alias("dst")))
    claims = found.join(located.select(F.col("claim_id").alias("node")), "node", "left_semi")
    return communities.rank_communities(claims).where("size > 1")


def community_summary(s, d):
    located = occ(s, d)
    return communities.community_summary(
        communities.shared_location_communities(located), graph.shared_pair_total(located)
    )


def communities_sql(select: str) -> str:
    return with_ctes(
        "located",
        f"""{select} FROM (SELECT location_key, n, row_number() OVER (ORDER BY n DESC, first) - 1 AS community_id
  FROM (SELECT location_key, count(*) AS n, min(claim_id) AS first FROM located WHERE location_key IS NOT NULL
        GROUP BY 1 HAVING count(*) > 1)) c JOIN located l ON c.location_key = l.location_key""",
    )


add(
    "policy_claims",
    lambda s, d: graph.claims_with_policy(fx.claims(s, d), fx.policies(s, d)).select(
        "claim_id", "policy_id", "premium", "deductible"
    ),
    with_ctes(
        "claims policies",
        "SELECT c.claim_id, c.policy_id, p.premium, p.deductible FROM claims c JOIN policies p ON c.policy_id = p.policy_id",
    ),
)
add(
    "shared_location_pairs",
    lambda s, d: graph.shared_location_links(occ(s, d)),
    with_ctes(
        "located",
        """SELECT first AS src, claim_id AS dst, n * (n - 1) // 2 AS location_pairs FROM (
  SELECT claim_id, min(claim_id) OVER (PARTITION BY location_key) AS first, count(*) OVER (PARTITION BY location_key) AS n
  FROM located WHERE location_key IS NOT NULL) WHERE claim_id <> first""",
    ),
)
add(
    "train_claims",
    train_claims,
    with_ctes("split", "SELECT claim_id, unnest(['column', 'ids']) AS via FROM split WHERE split = 'train'"),
)
add(
    "find_claims",
    lambda s, d: training.find_claims(fx.claims(s, d), wanted(s, d)),
    with_ctes(
        "claims",
        f"""SELECT w.claim_id, count(c.claim_id) AS matches,
  CASE count(c.claim_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS state
FROM {_wanted_sql} w LEFT JOIN claims c ON w.claim_id = c.claim_id GROUP BY w.claim_id""",
    ),
)
add(
    "find_graph_features",
    find_graph_features,
    with_ctes("location_safe", f"""SELECT w.claim_id, l.* EXCLUDE (claim_id), CASE WHEN l.claim_id IS NULL THEN 'missing' ELSE 'found' END AS state
FROM {_wanted_sql} w LEFT JOIN location_safe l ON w.claim_id = l.claim_id""",
    ),
)
add(
    "top_shared_locations",
    lambda s, d: graph.top_shared_locations(occ(s, d)),
    with_ctes(
        "located",
        """SELECT location_key, max(incident_state) AS state, max(incident_city) AS city, count(*) AS claim_count
FROM located WHERE location_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY claim_count DESC, location_key LIMIT 10""",
    ),
)
add(
    "graph_counts",
    graph_counts,
    with_ctes(
        "policies located attribute_long pairs",
        _counts_sql + " UNION ALL SELECT 'edge', 'SHARES_LOCATION_WITH', count(*) FROM pairs",
    ),
)
add(
    "feature_ranges",
    feature_ranges,
    with_ctes(
        "location_safe attribute_safe",
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, min({c}) AS min_value, max({c}) AS max_value FROM {t}"
            for t, columns in [("location_safe", LOCATION_FEATURES), ("attribute_safe", ATTRIBUTE_FEATURES)]
            for c in columns
        ),
    ),
)
add(
    "related_claims",
    lambda s, d: graph.related_claims(occ(s, d)).select(
        "claim_id", F.array_join("related_claim_ids", ",").alias("related"), "related_count"
    ),
    with_ctes(
        "located",
        """SELECT l.claim_id, coalesce(string_agg(r.other, ',' ORDER BY r.other), '') AS related, count(r.other) AS related_count
FROM located l LEFT JOIN (SELECT a.claim_id, b.claim_id AS other,
    row_number() OVER (PARTITION BY a.claim_id ORDER BY b.claim_id) AS rn
  FROM located a JOIN located b ON a.location_key = b.location_key AND a.claim_id <> b.claim_id) r
ON l.claim_id = r.claim_id AND r.rn <= 10 WHERE l.location_key IS NOT NULL GROUP BY l.claim_id""",
    ),
)
add(
    "entity_nodes",
    lambda s, d: graph.entity_nodes(fx.policies(s, d), fx.claims(s, d)),
    with_ctes(
        "policies located",
        """SELECT 'Policy' AS label, policy_id AS node_id, premium, deductible, CAST(NULL AS DATE) AS claim_date,
  CAST(NULL AS VARCHAR) AS claim_type, CAST(NULL AS DOUBLE) AS claimed_amount, CAST(NULL AS DOUBLE) AS total_claim_amount,
  CAST(NULL AS VARCHAR) AS collision_type, CAST(NULL AS VARCHAR) AS incident_severity,
  CAST(NULL AS VARCHAR) AS authorities_contacted, CAST(NULL AS VARCHAR) AS incident_state,
  CAST(NULL AS VARCHAR) AS incident_city, CAST(NULL AS BIGINT) AS incident_hour_of_day,
  CAST(NULL AS BIGINT) AS number_of_vehicles_involved, CAST(NULL AS BIGINT) AS bodily_injuries,
  CAST(NULL AS BIGINT) AS witnesses, CAST(NULL AS VARCHAR) AS police_report_available,
  CAST(NULL AS BOOLEAN) AS fraud_label FROM policies
UNION ALL SELECT 'Claim', claim_id, NULL, NULL, claim_date, claim_type, claimed_amount, total_claim_amount, collision_type,
  incident_severity, authorities_contacted, incident_state, incident_city, incident_hour_of_the_day,
  number_of_vehicles_involved, bodily_injuries, witnesses, police_report_available, fraud_label
FROM located WHERE policy_id IN (SELECT policy_id FROM policies)""",
    ),
)
add(
    "has_claim_edges",
    lambda s, d: graph.has_claim_edges(fx.claims(s, d), fx.policies(s, d)),
    with_ctes("claims policies", "SELECT policy_id AS src, claim_id AS dst, 'HAS_CLAIM' AS rel_type FROM claims WHERE policy_id IN (SELECT policy_id FROM policies)"),
)
add(
    "occurred_at_edges",
    lambda s, d: graph.occurred_at_edges(occ(s, d))
    .withColumn("kind", F.lit("edge"))
    .unionByName(
        graph.location_nodes(occ(s, d)).select(
            F.col("city").alias("src"), F.col("location_key").alias("dst"), F.col("state").alias("rel_type"), F.lit("node").alias("kind")
        )
    ),
    with_ctes(
        "located",
        """SELECT claim_id AS src, location_key AS dst, 'OCCURRED_AT' AS rel_type, 'edge' AS kind FROM located WHERE location_key IS NOT NULL
UNION ALL SELECT DISTINCT incident_city, location_key, incident_state, 'node' FROM located WHERE location_key IS NOT NULL""",
    ),
)
add(
    "attribute_edges",
    lambda s, d: graph.drop_obsolete(graph.attribute_edges(fx.claims(s, d))).unionByName(
        graph.attribute_nodes(fx.claims(s, d)).select(
            F.lit("node").alias("src"), F.col("node_id").alias("dst"), F.col("label").alias("rel_type")
        )
    ),
    with_ctes(
        "attribute_long",
        """SELECT claim_id AS src, value AS dst, rel_type FROM attribute_long
UNION ALL SELECT DISTINCT 'node', value, label FROM attribute_long""",
    ),
)
add(
    "location_features",
    lambda s, d: graph.location_features(fx.claims_table(s, d, "claim_id", "incident_state", "incident_city")),
    with_ctes(
        "located location_counts",
        """SELECT l.claim_id, coalesce(c.n - 1, 0) AS location_claim_count, coalesce(c.n - 1, 0) AS shared_location_degree
FROM located l LEFT JOIN location_counts c ON l.location_key = c.location_key""",
    ),
)
add(
    "split_safe_location_features",
    lambda s, d: graph.split_safe_location_features(fx.split_table(s, d, "incident_state", "incident_city")),
    with_ctes("location_safe", "SELECT * FROM location_safe"),
)
add(
    "split_safe_attribute_features",
    lambda s, d: graph.split_safe_attribute_features(
        fx.split_table(s, d, "claim_type", "collision_type", "incident_severity", "incident_state")
    ),
    with_ctes("attribute_safe", "SELECT * FROM attribute_safe"),
)
add(
    "shared_location_communities",
    lambda s, d: communities.shared_location_communities(occ(s, d)),
    communities_sql("SELECT c.community_id, c.n AS size, l.claim_id"),
)
add("louvain_communities", louvain, communities_sql("SELECT c.community_id, c.n AS size, l.claim_id"))
add(
    "community_summary",
    community_summary,
    with_ctes(
        "located pairs",
        """, sizes AS (SELECT n, row_number() OVER (ORDER BY n DESC, first) - 1 AS community_id FROM (
  SELECT location_key, count(*) AS n, min(claim_id) AS first FROM located WHERE location_key IS NOT NULL
  GROUP BY 1 HAVING count(*) > 1))
SELECT 'graph_nodes' AS metric, CAST(NULL AS BIGINT) AS community_id, CAST(sum(n) AS BIGINT) AS value FROM sizes
UNION ALL SELECT 'community_count', NULL, count(*) FROM sizes
UNION ALL SELECT 'graph_edges', NULL, count(*) FROM pairs
UNION ALL (SELECT 'largest', community_id, n FROM sizes ORDER BY n DESC, community_id LIMIT 10)""",
    ),
)
