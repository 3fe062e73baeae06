"""From raw claim rows to canonical policies and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.fixed import CARRIED_COLUMNS
from riskloom.functions.text import strip
from riskloom.operators.quality import DataQualityError, check_dates, check_domain, require, stop_on

DEFAULT_SOURCE = "claims_raw"


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip white space of every kind from every string column."""
    return df.select(
        *[
            strip(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def read_date(text: Column, formats: list[str] | None = None) -> Column:
    """The date that a text gives in ISO form, or in the first of `formats` (Spark date
    patterns) that fits; missing if there is none."""
    given = text.cast("string")
    return F.coalesce(given.try_cast("date"), *[F.try_to_date(given, pattern) for pattern in formats or []])


def parse_dates(df: DataFrame, column: str = "incident_date", formats: list[str] | None = None) -> DataFrame:
    """Turn date text into dates; text that is no date becomes missing."""
    return df.withColumn(column, read_date(F.col(column), formats))


def map_label(df: DataFrame, column: str = "fraud_reported", name: str = "fraud_label") -> DataFrame:
    """Add the boolean label: Y is true, N is false, anything else is missing."""
    return df.withColumn(name, F.when(F.col(column) == "Y", True).when(F.col(column) == "N", False))


def reject_bad_rows(raw: DataFrame) -> None:
    """Raise if a trimmed raw table has dates or labels that cannot be read."""
    require(check_dates(raw, ["incident_date"]))
    if not map_label(raw).where(F.col("fraud_label").isNull()).isEmpty():
        found = [r["value"] for r in check_domain(raw, "fraud_reported", ["Y", "N"]).limit(20).collect()]
        raise DataQualityError(f"unexpected labels: {found or 'missing'}")


def bad_rows(raw: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Rows `policy_id, column, value` whose date or label cannot be read."""
    trimmed = trim_strings(raw)
    date, label = F.col("incident_date").cast("string"), F.col("fraud_reported").cast("string")
    found = F.array_compact(
        F.array(
            F.when(read_date(date, formats).isNull(), F.struct(F.lit("incident_date").alias("column"), date.alias("value"))),
            F.when(~F.coalesce(label.isin("Y", "N"), F.lit(False)), F.struct(F.lit("fraud_reported").alias("column"), label.alias("value"))),
        )
    )
    return trimmed.select("policy_id", F.inline(found))


def clean_raw(raw: DataFrame, strict: bool = True, formats: list[str] | None = None) -> DataFrame:
    """Trimmed raw rows with parsed dates and the boolean label.

    A row whose date or label cannot be read stops every job that reads the rows,
    whatever columns it takes, unless `strict` is off: then the value is missing.
    `bad_rows` lists such rows. Dates and labels are parsed once.
    """
    trimmed = trim_strings(raw)
    parsed = map_label(parse_dates(trimmed.withColumn("_given", F.col("incident_date").cast("string")), formats=formats))
    if not strict:
        return parsed.drop("_given")
    tell = lambda name, value: F.concat(F.lit(f"{name} cannot be read: "), F.coalesce(F.col(value).cast("string"), F.lit("missing")))
    no_date, no_label = F.col("incident_date").isNull(), F.col("fraud_label").isNull()
    said = F.when(no_date, tell("incident_date", "_given")).otherwise(tell("fraud_reported", "fraud_reported"))
    return stop_on(parsed, no_date | no_label, said).drop("_given")


def canonical_policies(cleaned: DataFrame) -> DataFrame:
    """Nine-column policy table; attributes the source lacks are typed nulls."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return cleaned.select(
        "policy_id",
        text.alias("customer_id"),
        text.alias("policy_type"),
        text.alias("policy_start_date"),
        text.alias("policy_end_date"),
        F.col("policy_annual_premium").cast("double").alias("premium"),
        F.col("policy_deductible").cast("double").alias("deductible"),
        number.alias("coverage_amount"),
        text.alias("status"),
    )


def claim_id(policy_id: Column) -> Column:
    return F.concat(F.lit("CLM_"), policy_id)


def canonical_claims(cleaned: DataFrame, source: str = DEFAULT_SOURCE) -> DataFrame:
    """Claim table: one claim per policy, dated by its incident."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return cleaned.select(
        claim_id(F.col("policy_id")).alias("claim_id"),
        "policy_id",
        text.alias("customer_id"),
        F.col("incident_date").alias("claim_date"),
        "incident_date",
        F.col("incident_type").alias("claim_type"),
        text.alias("claim_description"),
        F.col("claim_amount").cast("double").alias("claimed_amount"),
        number.alias("approved_amount"),
        text.alias("status"),
        "fraud_label",
        *CARRIED_COLUMNS,
        F.lit(source).alias("source_dataset"),
    )


def export_dates(df: DataFrame) -> DataFrame:
    """Dates as ISO text, the form in which tables are exported."""
    return df.select(
        *[
            F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name)
            for f in df.schema
        ]
    )


def location_key(state: Column, city: Column) -> Column:
    """`state|city`; missing only if both are, a missing half is empty."""
    key = F.concat_ws("|", F.coalesce(state, F.lit("")), F.coalesce(city, F.lit("")))
    return F.when(F.coalesce(state, city).isNotNull(), key)


def with_location(claims: DataFrame) -> DataFrame:
    return claims.withColumn("location_key", location_key(F.col("incident_state"), F.col("incident_city")))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; names that are absent are ignored."""
    return df.drop(*columns)
