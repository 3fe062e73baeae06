"""Queries over readers, writers and normalization."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.fixed import CATEGORICAL, CLAIM_NUMERIC, DERIVED_NUMERIC, MIN_CATEGORY_COUNT
from riskloom.operators import encoding, graph, normalize
from riskloom.operators import features as feature_ops
from riskloom.plans import fixtures as fx
from riskloom.plans.oracle import with_ctes
from riskloom.plans.registry import REGISTRY
from riskloom.session import materialize, scratch_path
from riskloom.sources import documents, manifest, stores, tables

add = REGISTRY.add


def claims_scan(spark, sf):
    path = scratch_path(spark, "claims_csv")
    tables.write_table(fx.claims_raw(spark, sf), path, "csv")
    return tables.read_claims(spark, path, "csv")


def canonical_roundtrip(spark, sf):
    path = scratch_path(spark, "canonical")
    claims = fx.claims(spark, sf)
    tables.write_table(claims, path)
    return tables.read_table(spark, path, claims.schema).drop(*NULL_CLAIM_COLUMNS)


def documents_roundtrip(spark, sf):
    """Named documents written and read back whole, with their numbers."""
    path = scratch_path(spark, "documents")
    documents.write_collection(fx.documents(spark, sf), path)
    read = documents.read_collection(spark, path)
    return read.select("document_id", "source_file", "stem", F.length("text").cast("long").alias("characters"), F.sha2("text", 256).alias("sha256"))


def written_graph(spark, sf):
    """A graph that is written twice, first without its claims, and read back."""
    path = scratch_path(spark, "graph")
    policies, claims = fx.policies_table(spark, sf), fx.claims_table(spark, sf)
    for part in (claims.where("false"), claims):
        stores.write_graph(graph.property_nodes(policies, part), graph.linear_edges(policies, part), path)
    return stores.read_graph(spark, path)


def graph_roundtrip(spark, sf):
    read = written_graph(spark, sf)
    return graph.graph_counts(read.all_nodes(), read.edges)


def graph_properties(spark, sf):
    """Properties of the nodes that were read back."""
    nodes = written_graph(spark, sf).nodes
    policy = nodes["Policy"].select(F.lit("Policy").alias("label"), "node_id", "premium", "deductible")
    claim = nodes["Claim"].select(
        F.lit("Claim").alias("label"), "node_id", "claim_date", "claim_type", "claimed_amount", "total_claim_amount", "collision_type", "incident_severity",
        "authorities_contacted", "incident_state", "incident_city", "incident_hour_of_day", "number_of_vehicles_involved", "bodily_injuries", "witnesses",
        "police_report_available", "fraud_label",
    )
    place = nodes["IncidentLocation"].select(F.lit("IncidentLocation").alias("label"), "node_id", F.col("state").alias("incident_state"), F.col("city").alias("incident_city"))
    return policy.unionByName(claim, allowMissingColumns=True).unionByName(place, allowMissingColumns=True)


def broken_lines(spark, sf):
    """JSON lines of all documents, every seventh cut short: what is kept apart, and what is read."""
    path = scratch_path(spark, "lines")
    line = F.to_json(F.struct("document_id", "source_file"))
    cut = F.concat(F.lit('{"document_id": '), F.col("document_id").cast("string"))
    rows = fx.documents(spark, sf)
    rows.select(F.when(F.col("document_id") % 7 == 3, cut).otherwise(line).alias("value")).write.text(path)
    sound, broken = tables.read_sound_lines(spark, path, "document_id long, source_file string")
    return sound.select("document_id", "source_file", F.lit(None).cast("string").alias("line")).unionByName(broken.select("line"), allowMissingColumns=True)


def manifest_row(spark, sf):
    raw = fx.claims_raw(spark, sf)
    sources = [manifest.file_digests(spark, f"{sf}/{name}.parquet") for name in ("orders", "customer", "nation")]
    digest = manifest.combined_digest(sources[0].unionAll(sources[1]).unionAll(sources[2]))
    row = manifest.manifest(raw, fx.policies(spark, sf), fx.claims(spark, sf), "claims_raw", digest)
    return row.withColumn("digest_length", F.length("source_sha256").cast("long")).drop("source_sha256")


def encoder_for(spark, sf):
    """Base features of the split claims, written once, and the encoder fitted on train."""
    base = materialize(
        feature_ops.base_features(fx.claims_split(spark, sf), keep=("claim_id", "fraud_label")), "base_features"
    )
    train = base.where("split = 'train'")
    return base, encoding.ClaimEncoder.fit(train, CLAIM_NUMERIC + DERIVED_NUMERIC, CATEGORICAL)


def feature_metadata(spark, sf):
    base, encoder = encoder_for(spark, sf)
    counts = encoder.nonzero_counts(base.select("claim_id", *encoder.numeric, *encoder.categorical))
    nonzero = counts.join(base.select("claim_id", "split"), "claim_id")
    return stores.feature_metadata(nonzero, encoder.numeric, encoder.categorical, encoder.width, MIN_CATEGORY_COUNT)


def features_roundtrip(spark, sf):
    """Non-zero entries of the written sparse vectors, per split."""
    base, encoder = encoder_for(spark, sf)
    path = scratch_path(spark, "features")
    assembled = encoder.assemble(base, ["claim_id", "split", "fraud_label"])
    stores.write_features(assembled, path)
    read = stores.read_features(spark, path, assembled.schema)
    filled = F.size(F.filter(vector_to_array("features"), lambda x: F.abs(x) > 1e-12))
    return read.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("fraud_label").alias("positives"),
        F.sum(filled).alias("nonzero"),
    )


NULL_CLAIM_COLUMNS = ["customer_id", "claim_description", "approved_amount", "status"]

_counts_sql = """SELECT 'node' AS kind, label AS name, count(*) AS n FROM (
  SELECT 'Policy' AS label, policy_id AS id FROM policies UNION ALL SELECT 'Claim', claim_id FROM located
  UNION ALL SELECT DISTINCT 'IncidentLocation', location_key FROM located
  UNION ALL SELECT DISTINCT label, value FROM attribute_long) GROUP BY ALL
UNION ALL SELECT 'edge', rel_type, count(*) FROM (
  SELECT 'HAS_CLAIM' AS rel_type FROM located UNION ALL SELECT 'OCCURRED_AT' FROM located WHERE location_key IS NOT NULL
  UNION ALL SELECT rel_type FROM attribute_long) GROUP BY ALL"""

add("claims_scan", claims_scan, with_ctes("claims_raw", "SELECT * FROM claims_raw"))
add("claim_ids", lambda s, d: tables.claim_ids(fx.claims(s, d)), with_ctes("claims", "SELECT claim_id FROM claims"))
add(
    "documents_roundtrip",
    documents_roundtrip,
    """SELECT row_number() OVER (ORDER BY 'doc_' || doc_id || '.md') - 1 AS document_id, 'doc_' || doc_id || '.md' AS source_file,
  'doc_' || doc_id AS stem, length(text) AS characters, sha256(text) AS sha256 FROM documents""",
)
add(
    "canonical_roundtrip",
    canonical_roundtrip,
    with_ctes("claims", f"SELECT * EXCLUDE ({', '.join(NULL_CLAIM_COLUMNS)}) FROM claims"),
)
add(
    "manifest",
    manifest_row,
    with_ctes(
        "claims",
        """SELECT 'claims_raw' AS source_file, count(*) AS source_rows, count(*) AS policy_rows, count(*) AS claim_rows,
  count(*) FILTER (fraud_label) AS fraud_claims, count(*) FILTER (NOT fraud_label) AS non_fraud_claims,
  'policies' AS output_policies, 'claims' AS output_claims, CAST(64 AS BIGINT) AS digest_length FROM claims""",
    ),
)
add("graph_roundtrip", graph_roundtrip, with_ctes("policies located attribute_long", _counts_sql))
add(
    "graph_properties",
    graph_properties,
    with_ctes(
        "policies located",
        """SELECT 'Policy' AS label, policy_id AS node_id, premium, deductible, CAST(NULL AS DATE) AS claim_date,
  CAST(NULL AS VARCHAR) AS claim_type, CAST(NULL AS DOUBLE) AS claimed_amount, CAST(NULL AS DOUBLE) AS total_claim_amount,
  CAST(NULL AS VARCHAR) AS collision_type, CAST(NULL AS VARCHAR) AS incident_severity,
  CAST(NULL AS VARCHAR) AS authorities_contacted, CAST(NULL AS VARCHAR) AS incident_state,
  CAST(NULL AS VARCHAR) AS incident_city, CAST(NULL AS BIGINT) AS incident_hour_of_day,
  CAST(NULL AS BIGINT) AS number_of_vehicles_involved, CAST(NULL AS BIGINT) AS bodily_injuries,
  CAST(NULL AS BIGINT) AS witnesses, CAST(NULL AS VARCHAR) AS police_report_available, CAST(NULL AS BOOLEAN) AS fraud_label FROM policies
UNION ALL SELECT 'Claim', claim_id, NULL, NULL, claim_date, claim_type, claimed_amount, total_claim_amount, collision_type,
  incident_severity, authorities_contacted, incident_state, incident_city, incident_hour_of_the_day,
  number_of_vehicles_involved, bodily_injuries, witnesses, police_report_available, fraud_label FROM located
UNION ALL SELECT DISTINCT 'IncidentLocation', location_key, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, incident_state, incident_city,
  NULL, NULL, NULL, NULL, NULL, NULL FROM located""",
    ),
)
add(
    "broken_lines",
    broken_lines,
    """SELECT CASE WHEN doc_id % 7 <> 3 THEN doc_id END AS document_id, CASE WHEN doc_id % 7 <> 3 THEN 'doc_' || doc_id || '.md' END AS source_file,
  CASE WHEN doc_id % 7 = 3 THEN '{"document_id": ' || doc_id END AS line FROM documents""",
)
add(
    "features_roundtrip",
    features_roundtrip,
    with_ctes(
        "standard_long onehot",
        """SELECT b.split, count(*) AS row_count, count(*) FILTER (b.fraud_label) AS positives,
  (SELECT count(*) FROM standard_long s WHERE s.split = b.split AND abs(s.value) > 1e-12)
    + (SELECT count(*) FROM onehot o WHERE o.split = b.split) AS nonzero FROM base b GROUP BY b.split""",
    ),
)
add(
    "feature_metadata",
    feature_metadata,
    with_ctes(
        "standard_long onehot",
        f"""SELECT 'fraud_label' AS target, 'train_only' AS fit_scope,
  '{','.join(CLAIM_NUMERIC + DERIVED_NUMERIC)}' AS numeric_input_columns,
  '{','.join(CATEGORICAL)}' AS categorical_input_columns, CAST(29 AS BIGINT) AS raw_engineered_feature_count,
  17 + (SELECT count(*) FROM vocabulary) AS transformed_feature_count, CAST(10 AS BIGINT) AS onehot_min_frequency,
  """
        + ", ".join(
            f"""(SELECT count(*) FROM base WHERE split = '{s}') AS {s}_rows,
  (SELECT count(*) FROM standard_long WHERE split = '{s}' AND abs(value) > 1e-12)
    + (SELECT count(*) FROM onehot WHERE split = '{s}') AS {s}_matrix_nonzero"""
            for s in ["train", "validation", "test"]
        ),
    ),
)

# Normalization
_trim = r"'^[\t-\r\x1c-\x20\x{85}\pZ]+|[\t-\r\x1c-\x20\x{85}\pZ]+$'"
add(
    "trim_strings",
    lambda s, d: normalize.trim_strings(
        fx.table(s, d, "documents").select("doc_id", F.concat(F.lit(" \t "), "text", F.lit("\n ")).alias("text"))
    ).select("doc_id", F.length("text").cast("long").alias("characters"), F.md5("text").alias("digest")),
    f"""SELECT doc_id, length(t) AS characters, md5(t) AS digest FROM (
  SELECT doc_id, regexp_replace(text, {_trim}, '', 'g') AS t FROM documents)""",
)
add(
    "parse_dates",
    lambda s, d: normalize.parse_dates(fx.claims_raw(s, d)).select("policy_id", "incident_date"),
    with_ctes("claims_raw", "SELECT policy_id, TRY_CAST(incident_date AS DATE) AS incident_date FROM claims_raw"),
)
add(
    "label_map",
    lambda s, d: normalize.map_label(fx.claims_raw(s, d)).select("policy_id", "fraud_reported", "fraud_label"),
    with_ctes("claims_raw", "SELECT policy_id, fraud_reported, fraud_reported = 'Y' AS fraud_label FROM claims_raw"),
)
add("canonical_policies", lambda s, d: fx.policies(s, d), with_ctes("policies", "SELECT * FROM policies"))
add(
    "canonical_claims",
    lambda s, d: normalize.export_dates(fx.claims(s, d)),
    with_ctes(
        "claims",
        """SELECT * REPLACE (strftime(claim_date, '%Y-%m-%d') AS claim_date,
  strftime(incident_date, '%Y-%m-%d') AS incident_date) FROM claims""",
    ),
)
add(
    "location_key",
    lambda s, d: normalize.with_location(fx.claims(s, d)).select("claim_id", "location_key"),
    with_ctes("located", "SELECT claim_id, location_key FROM located"),
)
