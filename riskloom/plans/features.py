"""Queries over the split, features and the encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.fixed import ATTRIBUTE_FEATURES, CATEGORICAL, CLAIM_NUMERIC, DERIVED_NUMERIC, LOCATION_FEATURES
from riskloom.operators import encoding, graph
from riskloom.operators import features as ops
from riskloom.operators.split import stratified_split
from riskloom.plans import fixtures as fx
from riskloom.plans.oracle import with_ctes
from riskloom.plans.registry import REGISTRY
from riskloom.plans.tables import encoder_for
from riskloom.session import materialize

add = REGISTRY.add

NUMERIC = CLAIM_NUMERIC + DERIVED_NUMERIC
FLOATS = ["incident_hour_sin", "incident_hour_cos", "claim_to_total_ratio"]


def rounded(df, columns=FLOATS):
    """Floats to six digits, adding zero to lose the sign of a negative zero."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def rounded_sql(columns=FLOATS):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def graph_enhanced(s, d):
    claims = fx.split_table(s, d)
    g = graph.split_safe_location_features(claims)
    return rounded(ops.graph_features(claims, g, keep=("claim_id",)))


def combined(s, d):
    claims = fx.split_table(
        s, d, "claim_type", "collision_type", "incident_severity", "incident_state", "incident_city"
    )
    return ops.combine_graph_features(
        graph.split_safe_location_features(claims), graph.split_safe_attribute_features(claims)
    )


def multigraph(s, d):
    claims = fx.split_table(s, d)
    g = ops.combine_graph_features(
        graph.split_safe_location_features(claims), graph.split_safe_attribute_features(claims)
    )
    return rounded(ops.multigraph_features(claims, g, keep=("claim_id",)))


def base(s, d):
    return ops.base_features(fx.claims_split(s, d), keep=("claim_id",))


def base_table(s, d, columns):
    """Some of the base features, written."""
    return materialize(base(s, d).select("claim_id", "split", *columns), "base_features")


def numeric_stats(s, d):
    train = base_table(s, d, NUMERIC).where("split = 'train'")
    stats = encoding.fit_numeric(train, NUMERIC)
    return stats.select(
        "column", *[(F.round(c, 6) + 0.0).alias(c) for c in ["median", "mean", "stddev"]]
    )


def standardized(s, d):
    table = base_table(s, d, NUMERIC)
    stats = encoding.fit_numeric(table.where("split = 'train'"), NUMERIC)
    done = encoding.standardize(table, stats)
    return done.select("claim_id", "split", *[(F.round(c, 6) + 0.0).alias(c) for c in NUMERIC])


def categorical_modes(s, d):
    counts = encoding.category_counts(base(s, d).where("split = 'train'"), CATEGORICAL)
    return encoding.fit_categorical(counts, CATEGORICAL).select("column", "value", "train_count")


def onehot_vocabulary(s, d):
    counts = encoding.category_counts(base(s, d).where("split = 'train'"), CATEGORICAL)
    vocabulary = encoding.fit_vocabulary(counts, encoding.fit_categorical(counts, CATEGORICAL), CATEGORICAL)
    return vocabulary.select("column", "value", "infrequent", "train_count", "slot", "position")


def onehot_long(s, d):
    table, encoder = encoder_for(s, d)
    return encoder.onehot_long(table).select("claim_id", "column", "slot", "value")


def feature_matrix_nnz(s, d):
    table, encoder = encoder_for(s, d)
    return encoder.nonzero_counts(table)


_base_columns = ", ".join(CLAIM_NUMERIC + CATEGORICAL)
_exact = [c for c in DERIVED_NUMERIC if c not in FLOATS]
_base_sql = f"b.claim_id, b.split, {_base_columns}, {', '.join(_exact)}, {rounded_sql()}"

add(
    "stratified_split",
    lambda s, d: stratified_split(fx.claims(s, d).select("claim_id", "fraud_label")),
    with_ctes("split", "SELECT claim_id, fraud_label, split FROM split"),
)
add(
    "date_features",
    lambda s, d: ops.date_features(fx.claims(s, d)).select("claim_id", "incident_date", *DERIVED_NUMERIC[:6]),
    with_ctes("base", f"SELECT b.claim_id, s.incident_date, {', '.join('b.' + c for c in DERIVED_NUMERIC[:6])} FROM base b JOIN split s ON b.claim_id = s.claim_id"),
)
add(
    "hour_cycle",
    lambda s, d: rounded(ops.hour_cycle(fx.claims(s, d)), FLOATS[:2]).select("claim_id", *FLOATS[:2]),
    with_ctes("base", f"SELECT claim_id, {rounded_sql(FLOATS[:2])} FROM base"),
)


def amounts(s, d):
    """Without a premium, and with the premium of the claim's policy."""
    claims = fx.claims(s, d)
    plain = ops.amount_features(claims.select("claim_id", "claimed_amount", "total_claim_amount"))
    with_premium = ops.amount_features(
        claims.join(fx.policies(s, d), "policy_id").select("claim_id", "claimed_amount", "total_claim_amount", "premium")
    ).select("claim_id", "claim_to_premium_ratio")
    return rounded(plain.join(with_premium, "claim_id"), ["claim_to_total_ratio", "claim_to_premium_ratio"])


add(
    "amount_features",
    amounts,
    with_ctes(
        "claims policies",
        """SELECT c.claim_id, claimed_amount, total_claim_amount,
  round(claimed_amount / NULLIF(total_claim_amount, 0), 6) + 0.0 AS claim_to_total_ratio,
  total_claim_amount - claimed_amount AS claim_difference_from_total,
  round(claimed_amount / NULLIF(premium, 0), 6) + 0.0 AS claim_to_premium_ratio
FROM claims c JOIN policies p ON c.policy_id = p.policy_id""",
    ),
)
add("base_features", lambda s, d: rounded(base(s, d)), with_ctes("base", f"SELECT {_base_sql} FROM base b"))
add(
    "graph_enhanced_features",
    graph_enhanced,
    with_ctes(
        "base location_safe",
        f"SELECT {_base_sql}, {', '.join(LOCATION_FEATURES)} FROM base b JOIN location_safe l ON b.claim_id = l.claim_id",
    ),
)
add(
    "combined_graph_features",
    combined,
    with_ctes(
        "location_safe attribute_safe",
        f"SELECT l.claim_id, {', '.join(LOCATION_FEATURES + ATTRIBUTE_FEATURES)} FROM location_safe l JOIN attribute_safe a ON l.claim_id = a.claim_id",
    ),
)
add(
    "multigraph_features",
    multigraph,
    with_ctes(
        "base location_safe attribute_safe",
        f"""SELECT {_base_sql}, {', '.join(LOCATION_FEATURES + ATTRIBUTE_FEATURES)} FROM base b
JOIN location_safe l ON b.claim_id = l.claim_id JOIN attribute_safe a ON b.claim_id = a.claim_id""",
    ),
)
add(
    "feature_types",
    lambda s, d: ops.feature_types(base(s, d).drop("claim_id", "split")),
    with_ctes(
        "base",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{kind}' AS kind, CAST({i} AS BIGINT) AS ordinal, count({c}) AS row_values FROM base"
            for kind, columns in [("numeric", NUMERIC), ("categorical", CATEGORICAL)]
            for i, c in enumerate(columns)
        ),
    ),
)
add(
    "numeric_stats",
    numeric_stats,
    with_ctes(
        "numeric_stats",
        """SELECT col AS "column", round(median, 6) + 0.0 AS median, round(mean, 6) + 0.0 AS mean,
  round(stddev, 6) + 0.0 AS stddev FROM numeric_stats""",
    ),
)
add(
    "standardized_features",
    standardized,
    with_ctes(
        "standard_long",
        "SELECT claim_id, split, "
        + ", ".join(f"round(max(value) FILTER (col = '{c}'), 6) + 0.0 AS {c}" for c in NUMERIC)
        + " FROM standard_long GROUP BY claim_id, split",
    ),
)
add(
    "categorical_modes",
    categorical_modes,
    with_ctes("modes", "SELECT col AS \"column\", value, n AS train_count FROM modes"),
)
add(
    "onehot_vocabulary",
    onehot_vocabulary,
    with_ctes("vocabulary", "SELECT col AS \"column\", value, infrequent, n AS train_count, slot, position FROM vocabulary"),
)
add(
    "onehot_long",
    onehot_long,
    with_ctes("onehot", "SELECT claim_id, col AS \"column\", slot, CAST(1 AS DOUBLE) AS value FROM onehot"),
)
add(
    "feature_matrix_nnz",
    feature_matrix_nnz,
    with_ctes(
        "standard_long onehot",
        """SELECT n.claim_id, numeric_nonzero, onehot_nonzero, numeric_nonzero + onehot_nonzero AS nonzero FROM
  (SELECT claim_id, count(*) FILTER (abs(value) > 1e-12) AS numeric_nonzero FROM standard_long GROUP BY claim_id) n JOIN
  (SELECT claim_id, count(*) AS onehot_nonzero FROM onehot GROUP BY claim_id) o ON n.claim_id = o.claim_id""",
    ),
)
