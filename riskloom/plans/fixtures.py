"""Claim-shaped views over the given tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.normalize import canonical_claims, canonical_policies, clean_raw
from riskloom.operators.split import stratified_split
from riskloom.session import materialize

CLAIMS_RAW = """
SELECT
  'POL' || CAST(100000 + o.o_orderkey AS STRING) AS policy_id,
  'NATION_' || CAST(o.o_custkey % 25 AS STRING) AS policy_state,
  CAST(500 * (1 + o.o_orderkey % 4) AS BIGINT) AS policy_deductible,
  CAST(FLOOR(ABS(c.c_acctbal)) AS DOUBLE) AS policy_annual_premium,
  CAST(18 + o.o_custkey % 60 AS BIGINT) AS insured_age,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS insured_sex,
  'EDU_' || CAST(o.o_custkey % 7 AS STRING) AS insured_education_level,
  'OCC_' || CAST(o.o_custkey % 14 AS STRING) AS insured_occupation,
  c.c_mktsegment AS insured_hobbies,
  CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS incident_date,
  o.o_orderpriority AS incident_type,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Front' WHEN 1 THEN 'Rear' ELSE 'Side' END AS collision_type,
  CASE o.o_orderstatus WHEN 'F' THEN 'Total Loss' WHEN 'P' THEN 'Major Damage' ELSE 'Minor Damage' END AS incident_severity,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE 'AUTH_' || CAST(o.o_orderkey % 3 AS STRING) END AS authorities_contacted,
  n.n_name AS incident_state,
  'City_' || CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS incident_city,
  CAST(o.o_orderkey % 24 AS BIGINT) AS incident_hour_of_the_day,
  CAST(1 + o.o_orderkey % 4 AS BIGINT) AS number_of_vehicles_involved,
  CAST(o.o_orderkey % 3 AS BIGINT) AS bodily_injuries,
  CAST(o.o_orderkey % 5 AS BIGINT) AS witnesses,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS police_report_available,
  CAST(CAST(FLOOR(o.o_totalprice) AS BIGINT) * (11 + o.o_orderkey % 10) AS DOUBLE) / CAST(20 AS DOUBLE) AS claim_amount,
  CAST(FLOOR(o.o_totalprice) AS DOUBLE) AS total_claim_amount,
  CASE WHEN (o.o_orderkey * 7919 + o.o_custkey * 104729) % 1000
            < CASE o.o_orderstatus WHEN 'F' THEN 180 WHEN 'P' THEN 110 ELSE 55 END
       THEN 'Y' ELSE 'N' END AS fraud_reported
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

SCORED = """
SELECT 'CLM_POL' || CAST(100000 + o.o_orderkey AS STRING) AS claim_id,
  (o.o_orderkey * 7919 + o.o_custkey * 104729) % 1000
    < CASE o.o_orderstatus WHEN 'F' THEN 180 WHEN 'P' THEN 110 ELSE 55 END AS fraud_label,
  CAST((o.o_orderkey * 31 + o.o_custkey * 17) % 200
    + CASE o.o_orderstatus WHEN 'F' THEN 180 WHEN 'P' THEN 100 ELSE 20 END AS DOUBLE) / CAST(400 AS DOUBLE) AS score
FROM {orders} o
"""

# Questions about a claim, with the route that each should take.
ASKED = [
    ("How high is the fraud score of {claim}, and what makes up its risk?", "fraud"),
    ("List the claims connected with {claim}, and every neighbor of theirs.", "graph"),
    ("Which guideline tells how should a doubtful claim be handled?", "rag"),
    ("Please investigate {claim} from every side.", "investigation"),
    ("Is there a network or a community around {claim}?", "graph"),
    ("Quote the SOP and the policy on witnesses.", "rag"),
    ("  Show the RISK model for the related network  ", "fraud"),
    ("Good morning", "investigation"),
]


def _asked_sql() -> str:
    claim = "CLM_POL' || CAST(100000 + o.o_orderkey AS STRING) || '"
    questions = " ".join(f"WHEN {i} THEN '{q.format(claim=claim)}'" for i, (q, _) in enumerate(ASKED))
    routes = " ".join(f"WHEN {i} THEN '{route}'" for i, (_, route) in enumerate(ASKED))
    return f"CASE o.o_orderkey % {len(ASKED)} {questions} END AS question, CASE o.o_orderkey % {len(ASKED)} {routes} END AS expected_route"


QUESTIONS = f"""
SELECT o.o_orderkey AS case_id, 'CLM_POL' || CAST(100000 + o.o_orderkey AS STRING) AS claim_id, {_asked_sql()}
FROM {{orders}} o
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the partitions that the session's settings for files give it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ["orders", "customer", "nation"] if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    """The view's SQL over tables registered under their own names."""
    return sql.format(orders="orders", customer="customer", nation="nation")


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CLAIMS_RAW)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORED)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, QUESTIONS)


def claims_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Canonical claims, or some of their columns, written once: what operators that read
    their input several times are given."""
    df = claims(spark, sf_dir)
    return materialize(df.select(*columns) if columns else df, "claims")


def policies_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(policies(spark, sf_dir), "policies")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_policies(clean_raw(claims_raw(spark, sf_dir)))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_claims(clean_raw(claims_raw(spark, sf_dir)))


def claims_split(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Written claims with their split; `columns` besides the id and the label."""
    chosen = ["claim_id", "fraud_label", *columns] if columns else []
    return stratified_split(claims_table(spark, sf_dir, *chosen))


def split_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """As `claims_split`, written with the split."""
    chosen = ["claim_id", "fraud_label", *columns] if columns else []
    df = claims(spark, sf_dir)
    return materialize(stratified_split(df.select(*chosen) if chosen else df), "claims_split")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with their number and file name."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.concat(name, F.lit(".md")).alias("source_file"), name.alias("stem"), "text"
    )
