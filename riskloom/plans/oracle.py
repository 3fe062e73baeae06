"""Plain SQL for the same results, as common table expressions that build on each other."""

from __future__ import annotations

from riskloom.fixed import ATTRIBUTE_RELATIONS, CARRIED_COLUMNS, CATEGORICAL, CLAIM_NUMERIC, DERIVED_NUMERIC
from riskloom.plans import fixtures

TRIM = r"regexp_replace({0}, '^[\t-\r\x1c-\x20\x{{85}}\pZ]+|[\t-\r\x1c-\x20\x{{85}}\pZ]+$', '', 'g')"

_DERIVED = """
  CAST(year(incident_date) AS BIGINT) AS incident_year,
  CAST(month(incident_date) AS BIGINT) AS incident_month,
  CAST(day(incident_date) AS BIGINT) AS incident_day_of_month,
  CAST(isodow(incident_date) - 1 AS BIGINT) AS incident_day_of_week,
  CAST(dayofyear(incident_date) AS BIGINT) AS incident_day_of_year,
  CAST(isodow(incident_date) >= 6 AS BIGINT) AS incident_is_weekend,
  sin(2 * pi() * incident_hour_of_the_day / 24.0) AS incident_hour_sin,
  cos(2 * pi() * incident_hour_of_the_day / 24.0) AS incident_hour_cos,
  claimed_amount / NULLIF(total_claim_amount, 0) AS claim_to_total_ratio,
  total_claim_amount - claimed_amount AS claim_difference_from_total"""

_NUMERIC_LONG = ",\n  ".join(
    f"({i}, '{c}', CAST({c} AS DOUBLE))" for i, c in enumerate(CLAIM_NUMERIC + DERIVED_NUMERIC)
)
_CATEGORY_LONG = ", ".join(f"({i}, '{c}', {c})" for i, c in enumerate(CATEGORICAL))
_ATTRIBUTE_LONG = ", ".join(f"('{c}', '{rel}', '{label}', {c})" for c, rel, label, _ in ATTRIBUTE_RELATIONS)

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "claims_raw": ((), fixtures.duck(fixtures.CLAIMS_RAW)),
    "scored": ((), fixtures.duck(fixtures.SCORED)),
    "questions": ((), fixtures.duck(fixtures.QUESTIONS)),
    "policies": (
        ("claims_raw",),
        """SELECT policy_id, CAST(NULL AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS policy_type,
  CAST(NULL AS VARCHAR) AS policy_start_date, CAST(NULL AS VARCHAR) AS policy_end_date,
  policy_annual_premium AS premium, CAST(policy_deductible AS DOUBLE) AS deductible,
  CAST(NULL AS DOUBLE) AS coverage_amount, CAST(NULL AS VARCHAR) AS status FROM claims_raw""",
    ),
    "claims": (
        ("claims_raw",),
        f"""SELECT 'CLM_' || policy_id AS claim_id, policy_id, CAST(NULL AS VARCHAR) AS customer_id,
  CAST(incident_date AS DATE) AS claim_date, CAST(incident_date AS DATE) AS incident_date,
  incident_type AS claim_type, CAST(NULL AS VARCHAR) AS claim_description, claim_amount AS claimed_amount,
  CAST(NULL AS DOUBLE) AS approved_amount, CAST(NULL AS VARCHAR) AS status, fraud_reported = 'Y' AS fraud_label,
  {', '.join(CARRIED_COLUMNS)}, 'claims_raw' AS source_dataset FROM claims_raw""",
    ),
    "located": (
        ("claims",),
        """SELECT *, CASE WHEN incident_state IS NULL AND incident_city IS NULL THEN NULL
  ELSE coalesce(incident_state, '') || '|' || coalesce(incident_city, '') END AS location_key FROM claims""",
    ),
    "split": (
        ("located",),
        """SELECT * EXCLUDE (rn, held), CASE WHEN rn <= held THEN 'test' WHEN rn <= 2 * held THEN 'validation'
  ELSE 'train' END AS split FROM (SELECT *,
  row_number() OVER (PARTITION BY fraud_label ORDER BY md5('42:' || claim_id), claim_id) AS rn,
  (15 * count(*) OVER (PARTITION BY fraud_label) + 50) // 100 AS held FROM located)""",
    ),
    "location_counts": (("located",), "SELECT location_key, count(*) AS n FROM located WHERE location_key IS NOT NULL GROUP BY 1"),
    "pairs": (
        ("located",),
        """SELECT a.claim_id AS src, b.claim_id AS dst FROM located a
  JOIN located b ON a.location_key = b.location_key AND a.claim_id < b.claim_id""",
    ),
    "attribute_long": (
        ("located",),
        f"""SELECT l.claim_id, u.col, u.rel_type, u.label, u.value FROM located l,
  LATERAL (VALUES {_ATTRIBUTE_LONG}) AS u(col, rel_type, label, value) WHERE u.value IS NOT NULL""",
    ),
    "location_safe": (
        ("split",),
        """SELECT s.claim_id, s.split, coalesce(t.n, 0) AS train_location_claim_count,
  CASE WHEN s.split = 'train' THEN greatest(coalesce(t.n, 0) - 1, 0) ELSE coalesce(t.n, 0) END AS train_shared_location_degree
  FROM split s LEFT JOIN (SELECT location_key, count(*) AS n FROM split WHERE split = 'train' GROUP BY 1) t
  ON s.location_key = t.location_key""",
    ),
    "attribute_safe": (
        ("split",),
        "SELECT s.claim_id, s.split, "
        + ", ".join(
            f"greatest(coalesce((SELECT count(*) FROM split t WHERE t.split = 'train' AND t.{c} = s.{c}), 0)"
            f" - CASE WHEN s.split = 'train' THEN 1 ELSE 0 END, 0) AS {name}"
            for c, _, _, name in ATTRIBUTE_RELATIONS
        )
        + " FROM split s",
    ),
    "base": (
        ("split",),
        f"SELECT claim_id, split, fraud_label, {', '.join(CLAIM_NUMERIC)}, {', '.join(CATEGORICAL)},{_DERIVED} FROM split",
    ),
    "numeric_long": (
        ("base",),
        f"""SELECT b.claim_id, b.split, u.ordinal, u.col, u.value FROM base b,
  LATERAL (VALUES {_NUMERIC_LONG}) AS u(ordinal, col, value)""",
    ),
    "numeric_median": (
        ("numeric_long",),
        """SELECT ordinal, col, quantile_cont(value, 0.5) AS median FROM numeric_long WHERE split = 'train'
  GROUP BY ordinal, col""",
    ),
    "numeric_stats": (
        ("numeric_median",),
        """SELECT l.ordinal, l.col, m.median, avg(coalesce(l.value, m.median)) AS mean,
  stddev_pop(coalesce(l.value, m.median)) AS stddev FROM numeric_long l JOIN numeric_median m ON l.ordinal = m.ordinal
  WHERE l.split = 'train' GROUP BY l.ordinal, l.col, m.median""",
    ),
    "standard_long": (
        ("numeric_stats",),
        """SELECT l.claim_id, l.split, l.ordinal, l.col,
  (coalesce(l.value, s.median) - s.mean) / CASE WHEN s.stddev = 0 THEN 1 ELSE s.stddev END AS value
  FROM numeric_long l JOIN numeric_stats s ON l.ordinal = s.ordinal""",
    ),
    "category_long": (
        ("base",),
        f"""SELECT b.claim_id, b.split, u.ordinal, u.col, u.value FROM base b,
  LATERAL (VALUES {_CATEGORY_LONG}) AS u(ordinal, col, value)""",
    ),
    "modes": (
        ("category_long",),
        """SELECT ordinal, col, value, n + missing AS n FROM (SELECT c.*, coalesce(m.missing, 0) AS missing,
  row_number() OVER (PARTITION BY c.ordinal ORDER BY c.n DESC, c.value) AS rn
  FROM (SELECT ordinal, col, value, count(*) AS n FROM category_long WHERE split = 'train' AND value IS NOT NULL
        GROUP BY ordinal, col, value) c
  LEFT JOIN (SELECT ordinal, count(*) AS missing FROM category_long WHERE split = 'train' AND value IS NULL
        GROUP BY ordinal) m ON c.ordinal = m.ordinal) WHERE rn = 1""",
    ),
    "filled_long": (
        ("modes",),
        """SELECT l.claim_id, l.split, l.ordinal, l.col, coalesce(l.value, m.value) AS value
  FROM category_long l JOIN modes m ON l.ordinal = m.ordinal""",
    ),
    "vocabulary": (
        ("filled_long",),
        """SELECT ordinal, col, value, infrequent, n,
  row_number() OVER (PARTITION BY ordinal ORDER BY infrequent, value) - 1 AS slot,
  row_number() OVER (ORDER BY ordinal, infrequent, value) - 1 AS position
  FROM (SELECT ordinal, col, CASE WHEN n >= 10 THEN value END AS value, n < 10 AS infrequent, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT ordinal, col, value, count(*) AS n FROM filled_long WHERE split = 'train' GROUP BY ordinal, col, value)
        GROUP BY 1, 2, 3, 4)""",
    ),
    "onehot": (
        ("vocabulary",),
        """SELECT l.claim_id, l.split, l.ordinal, l.col, coalesce(v.slot, r.slot) AS slot,
  coalesce(v.position, r.position) AS position FROM filled_long l
  LEFT JOIN vocabulary v ON l.ordinal = v.ordinal AND l.value = v.value AND NOT v.infrequent
  LEFT JOIN vocabulary r ON l.ordinal = r.ordinal AND r.infrequent
  WHERE coalesce(v.slot, r.slot) IS NOT NULL""",
    ),
}


def _needed(names: list[str], found: list[str]) -> list[str]:
    for name in names:
        if name not in found:
            _needed(list(CTES[name][0]), found)
            found.append(name)
    return found


def with_ctes(names: str, query: str) -> str:
    """Prefix a query with the named expressions and all they need."""
    parts = ",\n".join(f"{name} AS (\n{CTES[name][1]}\n)" for name in _needed(names.split(), []))
    return f"WITH {parts}{query}" if query.startswith(",") else f"WITH {parts}\n{query}"
