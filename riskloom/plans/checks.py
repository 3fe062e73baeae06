"""Queries over data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.fixed import ATTRIBUTE_FEATURES, LOCATION_FEATURES, RAW_COLUMNS, RAW_LABELS, RAW_NUMERIC
from riskloom.operators import features as feature_ops
from riskloom.operators import graph
from riskloom.operators import quality as q
from riskloom.operators.split import stratified_split
from riskloom.plans import fixtures as fx
from riskloom.plans.oracle import with_ctes
from riskloom.plans.registry import REGISTRY
from riskloom.sources.manifest import manifest

add = REGISTRY.add


def report_sql(ctes: str, checks: dict[str, str]) -> str:
    """SQL for check rows from counting expressions."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", CAST(({sql}) AS BIGINT) AS violations" for name, sql in checks.items())
    return with_ctes(ctes, f"""SELECT "check", violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({rows})""")


def column_rows_sql(ctes: str, table: str, columns: dict[str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{state}' AS state, "
        + (f"(SELECT count({c}) FROM {table})" if state != "missing" else "CAST(0 AS BIGINT)")
        + " AS row_values"
        for c, state in columns.items()
    )
    return with_ctes(ctes, rows)


# A required column is missing and another one is unexpected.
add(
    "dq_columns",
    lambda s, d: q.check_columns(
        fx.claims_raw(s, d).drop("witnesses").withColumn("note", F.col("insured_sex")), RAW_COLUMNS
    ),
    column_rows_sql(
        "claims_raw",
        "(SELECT *, insured_sex AS note FROM claims_raw)",
        {**{c: "missing" if c == "witnesses" else "present" for c in RAW_COLUMNS}, "note": "unexpected"},
    ),
)
add(
    "dq_non_empty",
    lambda s, d: q.check_non_empty(fx.claims_raw(s, d)),
    report_sql("claims_raw", {"non_empty": "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM claims_raw"}),
)
add(
    "dq_key_nulls",
    lambda s, d: q.check_not_null(fx.claims_raw(s, d), ["policy_id", "authorities_contacted", "fraud_reported"]),
    report_sql(
        "claims_raw",
        {
            f"not_null:{c}": f"SELECT count(*) FROM claims_raw WHERE {c} IS NULL"
            for c in ["policy_id", "authorities_contacted", "fraud_reported"]
        },
    ),
)
# Line items repeat their order key; claims do not repeat theirs.
add(
    "dq_duplicate_keys",
    lambda s, d: q.check_unique(fx.claims(s, d), "claim_id").unionByName(
        q.check_unique(fx.table(s, d, "lineitem"), "l_orderkey")
    ),
    report_sql(
        "claims",
        {
            "unique:claim_id": "SELECT count(*) - count(DISTINCT claim_id) FROM claims",
            "unique:l_orderkey": "SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem",
        },
    ),
)
add(
    "dq_duplicate_rows",
    lambda s, d: q.check_duplicate_rows(
        fx.claims_raw(s, d).unionByName(fx.claims_raw(s, d).where("fraud_reported = 'Y'"))
    ),
    report_sql("claims_raw", {"duplicate_rows": "SELECT count(*) FROM claims_raw WHERE fraud_reported = 'Y'"}),
)
add(
    "dq_domain",
    lambda s, d: q.check_domain(fx.claims_raw(s, d), "fraud_reported", RAW_LABELS)
    .withColumn("column", F.lit("fraud_reported"))
    .unionByName(
        q.check_domain(fx.claims_raw(s, d), "collision_type", ["Front", "Rear"]).withColumn(
            "column", F.lit("collision_type")
        )
    ),
    with_ctes(
        "claims_raw",
        """SELECT 'fraud_reported' AS "column", fraud_reported AS value, count(*) AS row_count FROM claims_raw
WHERE fraud_reported NOT IN ('Y', 'N') GROUP BY ALL
UNION ALL SELECT 'collision_type', collision_type, count(*) FROM claims_raw
WHERE collision_type NOT IN ('Front', 'Rear') GROUP BY ALL""",
    ),
)
add(
    "dq_numeric",
    lambda s, d: q.check_numeric(fx.claims_raw(s, d), [*RAW_NUMERIC, "incident_severity"]),
    report_sql(
        "claims_raw",
        {
            f"numeric:{c}": f"SELECT count(*) FROM claims_raw WHERE TRY_CAST({c} AS DOUBLE) IS NULL"
            for c in [*RAW_NUMERIC, "incident_severity"]
        },
    ),
)
add(
    "dq_dates",
    lambda s, d: q.check_dates(fx.claims_raw(s, d), ["incident_date", "incident_city"]),
    report_sql(
        "claims_raw",
        {
            f"date:{c}": f"SELECT count(*) FROM claims_raw WHERE TRY_CAST({c} AS DATE) IS NULL"
            for c in ["incident_date", "incident_city"]
        },
    ),
)
add(
    "missing_report",
    lambda s, d: q.missing_report(fx.claims(s, d)),
    with_ctes(
        "claims",
        """SELECT * FROM (
"""
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
            f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS percent FROM claims"
            for c in [
                "claim_id", "policy_id", "customer_id", "claim_date", "incident_date", "claim_type",
                "claim_description", "claimed_amount", "approved_amount", "status", "fraud_label", "policy_state",
                "insured_age", "insured_sex", "insured_education_level", "insured_occupation", "insured_hobbies",
                "collision_type", "incident_severity", "authorities_contacted", "incident_state", "incident_city",
                "incident_hour_of_the_day", "number_of_vehicles_involved", "bodily_injuries", "witnesses",
                "police_report_available", "total_claim_amount", "source_dataset",
            ]
        )
        + ") WHERE missing > 0",
    ),
)
add(
    "class_distribution",
    lambda s, d: q.class_distribution(fx.claims(s, d).transform(stratified_split), "fraud_label", "split").unionByName(
        q.class_distribution(fx.claims(s, d), "fraud_label").withColumn("split", F.lit("all"))
    ),
    with_ctes(
        "split",
        """SELECT split, fraud_label, n AS row_count,
  round(n * CAST(100 AS DOUBLE) / sum(n) OVER (PARTITION BY split), 6) AS percent FROM (
  SELECT split, fraud_label, count(*) AS n FROM split GROUP BY 1, 2
  UNION ALL SELECT 'all', fraud_label, count(*) FROM split GROUP BY 2)""",
    ),
)
add(
    "dq_row_counts",
    lambda s, d: q.check_row_counts(
        {"raw": fx.claims_raw(s, d), "policies": fx.policies(s, d), "claims": fx.claims(s, d), "lines": fx.table(s, d, "lineitem")}
    ),
    report_sql(
        "claims policies",
        {
            "row_count:policies": "SELECT abs((SELECT count(*) FROM policies) - (SELECT count(*) FROM claims_raw))",
            "row_count:claims": "SELECT abs((SELECT count(*) FROM claims) - (SELECT count(*) FROM claims_raw))",
            "row_count:lines": "SELECT abs((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM claims_raw))",
        },
    ),
)
# Claims against policies, and against the policies of claims that were reported as fraud.
add(
    "dq_orphans",
    lambda s, d: q.check_foreign_key(fx.claims(s, d), fx.policies(s, d), "policy_id").unionByName(
        q.check_foreign_key(fx.claims(s, d), fx.claims_raw(s, d).where("fraud_reported = 'Y'"), "policy_id").withColumn(
            "check", F.lit("foreign_key:fraud_policy")
        )
    ),
    report_sql(
        "claims policies",
        {
            "foreign_key:policy_id": "SELECT count(*) FROM claims WHERE policy_id NOT IN (SELECT policy_id FROM policies)",
            "foreign_key:fraud_policy": "SELECT count(*) FROM claims WHERE policy_id NOT IN "
            "(SELECT policy_id FROM claims_raw WHERE fraud_reported = 'Y')",
        },
    ),
)
add(
    "dq_label_counts",
    lambda s, d: q.check_counts(fx.claims(s, d), "fraud_label", {True: 3440, False: 26560}),
    report_sql(
        "claims",
        {
            "count:fraud_label=true": "SELECT abs(count(*) FILTER (fraud_label) - 3440) FROM claims",
            "count:fraud_label=false": "SELECT abs(count(*) FILTER (NOT fraud_label) - 26560) FROM claims",
        },
    ),
)


def dq_manifest(s, d):
    raw, policies, claims = fx.claims_raw(s, d), fx.policies(s, d), fx.claims(s, d)
    recorded = manifest(raw, policies, claims, "claims_raw").withColumn("fraud_claims", F.col("fraud_claims") + 1)
    return q.check_manifest(recorded, raw, policies, claims)


add(
    "dq_manifest",
    dq_manifest,
    report_sql(
        "claims",
        {
            **{f"manifest:{c}": "SELECT 0" for c in ["records", "source_rows", "policy_rows", "claim_rows"]},
            "manifest:fraud_claims": "SELECT (count(*) FILTER (fraud_label) + 1) - count(*) FILTER (fraud_label) FROM claims",
            "manifest:non_fraud_claims": "SELECT 0",
        },
    ),
)
add(
    "dq_key_parity",
    lambda s, d: q.check_same_keys(fx.claims(s, d), fx.scored(s, d).where("score >= 0.25"), "claim_id"),
    report_sql(
        "claims scored",
        {
            "keys:left_only": "SELECT count(*) FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM scored WHERE score >= 0.25)",
            "keys:right_only": "SELECT count(*) FROM scored WHERE score >= 0.25 AND claim_id NOT IN (SELECT claim_id FROM claims)",
        },
    ),
)


def dq_split_partition(s, d):
    """The split itself, and one that repeats the test rows and lacks the validation rows."""
    split = fx.split_table(s, d, "policy_id")
    broken = split.where("split <> 'validation'").unionAll(split.where("split = 'test'"))
    return (
        q.check_partition(split, fx.claims(s, d), "claim_id")
        .withColumn("of", F.lit("split"))
        .unionByName(q.check_partition(broken, fx.claims(s, d), "claim_id").withColumn("of", F.lit("broken")))
    )


add(
    "dq_split_partition",
    dq_split_partition,
    with_ctes(
        "split",
        """SELECT "of", "check", violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'split' AS "of", unnest(['partition:overlap', 'partition:uncovered', 'partition:foreign']) AS "check", CAST(0 AS BIGINT) AS violations
  UNION ALL SELECT 'broken', 'partition:overlap', count(*) FROM split WHERE split = 'test'
  UNION ALL SELECT 'broken', 'partition:uncovered', count(*) FROM split WHERE split = 'validation'
  UNION ALL SELECT 'broken', 'partition:foreign', 0)""",
    ),
)
add(
    "one_to_one_join",
    lambda s, d: q.one_to_one_join(
        fx.claims(s, d).select("claim_id", "claimed_amount"), fx.scored(s, d).select("claim_id", "score"), "claim_id"
    ),
    with_ctes("claims scored", "SELECT c.claim_id, c.claimed_amount, s.score FROM claims c JOIN scored s ON c.claim_id = s.claim_id"),
)


def dq_features_complete(s, d):
    claims = fx.split_table(
        s, d, "claim_type", "collision_type", "incident_severity", "incident_state", "incident_city", "authorities_contacted"
    )
    joined = graph.split_safe_location_features(claims).join(
        graph.split_safe_attribute_features(claims).drop("split"), "claim_id"
    )
    return q.check_complete(joined, LOCATION_FEATURES + ATTRIBUTE_FEATURES).unionByName(
        q.check_complete(claims, ["claim_type", "authorities_contacted"]).withColumn("check", F.lit("complete:claims"))
    )


add(
    "dq_features_complete",
    dq_features_complete,
    report_sql(
        "claims location_safe attribute_safe",
        {
            "complete": "SELECT count(*) FROM location_safe l JOIN attribute_safe a ON l.claim_id = a.claim_id WHERE "
            + " OR ".join(f"{c} IS NULL" for c in LOCATION_FEATURES + ATTRIBUTE_FEATURES),
            "complete:claims": "SELECT count(*) FROM claims WHERE claim_type IS NULL OR authorities_contacted IS NULL",
        },
    ),
)


def dq_schema_parity(s, d):
    claims = fx.split_table(s, d)
    parts = {p: feature_ops.base_features(claims.where(F.col("split") == p)) for p in ["train", "validation", "test"]}
    parts["test"] = parts["test"].drop("witnesses")
    return q.check_schema_parity(parts)


# The dropped column is the 17th of 30: 13 later positions differ, and one is missing.
add(
    "dq_schema_parity",
    dq_schema_parity,
    with_ctes(
        "split",
        """SELECT split AS "table", count(*) AS row_count, CAST(CASE WHEN split = 'test' THEN 29 ELSE 30 END AS BIGINT) AS column_count,
  CAST(CASE WHEN split = 'test' THEN 14 ELSE 0 END AS BIGINT) AS violations,
  CASE WHEN split = 'test' THEN 'fail' ELSE 'pass' END AS status FROM split GROUP BY split""",
    ),
)
