"""Fixed values that results depend on: column lists, word lists, patterns and texts."""

from pyspark.sql import types as T

# --- Fixed values: the 24 raw claim columns and their kinds -------------------------
RAW_SCHEMA = T.StructType(
    [
        T.StructField("policy_id", T.StringType()),
        T.StructField("policy_state", T.StringType()),
        T.StructField("policy_deductible", T.LongType()),
        T.StructField("policy_annual_premium", T.DoubleType()),
        T.StructField("insured_age", T.LongType()),
        T.StructField("insured_sex", T.StringType()),
        T.StructField("insured_education_level", T.StringType()),
        T.StructField("insured_occupation", T.StringType()),
        T.StructField("insured_hobbies", T.StringType()),
        T.StructField("incident_date", T.StringType()),
        T.StructField("incident_type", T.StringType()),
        T.StructField("collision_type", T.StringType()),
        T.StructField("incident_severity", T.StringType()),
        T.StructField("authorities_contacted", T.StringType()),
        T.StructField("incident_state", T.StringType()),
        T.StructField("incident_city", T.StringType()),
        T.StructField("incident_hour_of_the_day", T.LongType()),
        T.StructField("number_of_vehicles_involved", T.LongType()),
        T.StructField("bodily_injuries", T.LongType()),
        T.StructField("witnesses", T.LongType()),
        T.StructField("police_report_available", T.StringType()),
        T.StructField("claim_amount", T.DoubleType()),
        T.StructField("total_claim_amount", T.DoubleType()),
        T.StructField("fraud_reported", T.StringType()),
    ]
)
RAW_COLUMNS = RAW_SCHEMA.fieldNames()
RAW_NUMERIC = [f.name for f in RAW_SCHEMA if not isinstance(f.dataType, T.StringType)]
RAW_LABELS = ["Y", "N"]

# --- Fixed values: text that a CSV reader takes as missing --------------------------
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: attributes a claim carries over from the raw row ------------------
CARRIED_COLUMNS = [
    "policy_state",
    "insured_age",
    "insured_sex",
    "insured_education_level",
    "insured_occupation",
    "insured_hobbies",
    "collision_type",
    "incident_severity",
    "authorities_contacted",
    "incident_state",
    "incident_city",
    "incident_hour_of_the_day",
    "number_of_vehicles_involved",
    "bodily_injuries",
    "witnesses",
    "police_report_available",
    "total_claim_amount",
]

# --- Fixed values: columns that never reach a model ----------------------------------
IDENTIFIER_COLUMNS = ["claim_id", "policy_id", "source_dataset"]
TARGET = "fraud_label"
NON_FEATURE_COLUMNS = [
    TARGET,
    "customer_id",
    "claim_description",
    "approved_amount",
    "status",
    "claim_date",
    "incident_date",
]

# --- Fixed values: model inputs in column order --------------------------------------
CLAIM_NUMERIC = [
    "claimed_amount",
    "insured_age",
    "incident_hour_of_the_day",
    "number_of_vehicles_involved",
    "bodily_injuries",
    "witnesses",
    "total_claim_amount",
]
DERIVED_NUMERIC = [
    "incident_year",
    "incident_month",
    "incident_day_of_month",
    "incident_day_of_week",
    "incident_day_of_year",
    "incident_is_weekend",
    "incident_hour_sin",
    "incident_hour_cos",
    "claim_to_total_ratio",
    "claim_difference_from_total",
]
CATEGORICAL = [
    "claim_type",
    "policy_state",
    "insured_sex",
    "insured_education_level",
    "insured_occupation",
    "insured_hobbies",
    "collision_type",
    "incident_severity",
    "authorities_contacted",
    "incident_state",
    "incident_city",
    "police_report_available",
]
LOCATION_FEATURES = ["train_location_claim_count", "train_shared_location_degree"]
ATTRIBUTE_FEATURES = [
    "train_same_incident_type",
    "train_same_collision_type",
    "train_same_severity",
    "train_same_incident_state",
]
MIN_CATEGORY_COUNT = 10
INFREQUENT_NAME = "infrequent_sklearn"

# --- Fixed values: graph attributes: claim column, edge type, node label, feature -----
ATTRIBUTE_RELATIONS = [
    ("claim_type", "HAS_INCIDENT_TYPE", "IncidentType", "train_same_incident_type"),
    ("collision_type", "HAS_COLLISION_TYPE", "CollisionType", "train_same_collision_type"),
    ("incident_severity", "HAS_SEVERITY", "IncidentSeverity", "train_same_severity"),
    ("incident_state", "HAS_INCIDENT_STATE", "IncidentState", "train_same_incident_state"),
]
OBSOLETE_RELATIONS = [
    "SHARES_INCIDENT_TYPE",
    "SHARES_COLLISION_TYPE",
    "SHARES_SEVERITY",
    "SHARES_INCIDENT_STATE",
]

# --- Fixed values: limits and thresholds ----------------------------------------------
RELATED_CAP = 10
FLAG_THRESHOLD = 0.5
DEFAULT_TOP_K = 3
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
SPLIT_SEED = 42

# --- Fixed values: routing keywords ----------------------------------------------------
FRAUD_KEYWORDS = [
    "fraud",
    "risk",
    "score",
    "probability",
    "predict",
    "prediction",
    "model",
    "flag",
    "threshold",
]
GRAPH_KEYWORDS = [
    "graph",
    "relationship",
    "related",
    "connected",
    "connection",
    "location",
    "neighbor",
    "community",
    "network",
    "claims linked",
]
RAG_KEYWORDS = [
    "policy",
    "procedure",
    "guideline",
    "guidance",
    "sop",
    "standard",
    "how should",
    "how do i",
    "review process",
    "investigation process",
]
INVESTIGATION_KEYWORDS = [
    "investigate",
    "investigation",
    "case investigation",
    "full investigation",
    "full review",
    "complete investigation",
    "analyze this claim",
    "assess this claim",
]
REASON_INVESTIGATION = "Question requests a case-level or claim-level investigation."
REASON_DEFAULT = "No specialist intent detected; defaulting to full investigation."
REASON_SPECIALIST = "Detected %d %s-specific keyword match(es)."

# --- Fixed values: report rubric -------------------------------------------------------
REQUIRED_SECTIONS = [
    "Executive Summary",
    "Claim Facts",
    "Fraud Model Signal",
    "Graph Evidence",
    "Retrieved Guidance",
    "Investigation Considerations",
    "Evidence Limitations",
]
UNSAFE_PATTERNS = [
    r"\bclaim\s+(?:is|was)\s+fraudulent\b",
    r"\bthe\s+claim\s+(?:is|was)\s+fraudulent\b",
    r"\bconfirmed\s+fraud\b",
    r"\bdefinitively\s+fraudulent\b",
    r"\bdefinitive\s+fraud\s+determination\b",
]
NEGATION_MARKERS = [
    "no ",
    "not ",
    "cannot ",
    "can't ",
    "does not ",
    "do not ",
    "did not ",
    "without ",
    "rather than ",
]
NEGATION_REACH = 80

# --- Fixed values: evidence report wording ----------------------------------------------
REPORT_TITLE = "# Investigation Report — "
REPORT_QUESTION = "Investigation question: "
HEADING_SCORE = "## Fraud Model Signal"
HEADING_CLAIM = "## Claim Evidence"
HEADING_GRAPH = "## Graph Evidence"
HEADING_GUIDANCE = "## Retrieved Guidance"
HEADING_INTERPRETATION = "## Investigation Interpretation"
SCORE_SENTENCE = "The model produced a risk score of %.4f, which is %s the configured threshold of %.2f."
LABEL_DATE = "Incident date"
LABEL_TYPE = "Claim type"
LABEL_CLAIMED = "Claimed amount"
LABEL_TOTAL = "Total claim amount"
LABEL_LOCATION = "Incident location"
LABEL_POLICE = "Police report available"
LABEL_INCIDENT = "Incident type"
LABEL_COLLISION = "Collision type"
LABEL_SEVERITY = "Severity"
LABEL_SHARING = "Claims sharing the incident location"
LABEL_RELATED = "Related claim IDs"
RETRIEVED_SENTENCE = "Retrieved %s knowledge chunks."
LABEL_SOURCES = "Sources"
SCORE_CAVEAT = "This score is a model-derived risk signal and is not, by itself, proof of fraud."
NO_RELATED_CLAIMS = "No shared-location claim relationships were returned for this claim."
NO_DOCUMENTS = "No documents retrieved."
INTERPRETATION = [
    "The available evidence should be reviewed together. Model output, graph relationships, "
    "and procedural guidance are separate evidence types and should not be treated as interchangeable.",
    "A detected graph relationship or elevated model score is an investigation signal rather "
    "than a definitive fraud determination.",
]

# Placed before an evidence package by default; no result depends on the wording.
PROMPT_INSTRUCTIONS = """Below is the evidence on one insurance claim, as JSON. Write a short report for the
investigator who has the claim on their desk.

Keep to what the evidence says. Where a part of it is null, say that this part is missing
instead of filling the gap. Keep three things apart: what is recorded about the claim, what the
model computed, and what the guidance recommends. A score, a shared location or a passage of
guidance is a reason to look closer; whether there was fraud is not yours to decide.

Give each of these a heading of its own: summary, recorded facts, model score, graph, guidance,
what to look at next, what is missing.
"""
