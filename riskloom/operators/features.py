"""Row-wise model features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.fixed import ATTRIBUTE_FEATURES, IDENTIFIER_COLUMNS, LOCATION_FEATURES, NON_FEATURE_COLUMNS
from riskloom.functions.numbers import hour_angle, ratio
from riskloom.operators.normalize import drop_columns
from riskloom.operators.quality import any_missing, one_to_one_join, stop_on


def date_features(df: DataFrame, date: str = "incident_date") -> DataFrame:
    """Calendar parts; the week starts on Monday with 0."""
    day = F.col(date)
    return df.withColumns(
        {
            "incident_year": F.year(day).cast("long"),
            "incident_month": F.month(day).cast("long"),
            "incident_day_of_month": F.dayofmonth(day).cast("long"),
            "incident_day_of_week": F.weekday(day).cast("long"),
            "incident_day_of_year": F.dayofyear(day).cast("long"),
            "incident_is_weekend": (F.weekday(day) >= 5).cast("long"),
        }
    )


def hour_cycle(df: DataFrame, hour: str = "incident_hour_of_the_day") -> DataFrame:
    """Hour of day on a circle."""
    angle = hour_angle(F.col(hour))
    return df.withColumns({"incident_hour_sin": F.sin(angle), "incident_hour_cos": F.cos(angle)})


def amount_features(df: DataFrame, use_premium: bool = True) -> DataFrame:
    """Ratio of the claim to the total, or to the premium where one is present, and the
    part of the total that is not claimed."""
    claimed, total = F.col("claimed_amount"), F.col("total_claim_amount")
    if use_premium and "premium" in df.columns:
        df = df.withColumn("claim_to_premium_ratio", ratio(claimed, F.col("premium")))
    else:
        df = df.withColumn("claim_to_total_ratio", ratio(claimed, total))
    return df.withColumn("claim_difference_from_total", total - claimed)


def _model_features(df: DataFrame, use_premium: bool, keep: list[str]) -> DataFrame:
    derived = amount_features(hour_cycle(date_features(df)), use_premium)
    dropped = [c for c in IDENTIFIER_COLUMNS + NON_FEATURE_COLUMNS if c not in keep]
    return drop_columns(derived, dropped)


def base_features(claims: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Model inputs from claims alone. `keep` retains identifiers or the label."""
    return _model_features(claims, True, list(keep))


def _joined(claims: DataFrame, graph: DataFrame, columns: list[str], keep: tuple[str, ...]) -> DataFrame:
    data = one_to_one_join(claims, graph.select("claim_id", *columns), "claim_id", "left")
    return _model_features(_complete(data, columns), False, list(keep))


def _complete(data: DataFrame, columns: list[str]) -> DataFrame:
    """A row without all graph features stops the job, whatever columns are read."""
    return stop_on(data, any_missing(columns), "missing graph features after join")


def graph_features(claims: DataFrame, graph: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Model inputs with the location features of the claim graph."""
    return _joined(claims, graph, LOCATION_FEATURES, keep)


def combine_graph_features(location: DataFrame, attributes: DataFrame) -> DataFrame:
    """Location and attribute features side by side, one row per claim."""
    combined = one_to_one_join(
        location.select("claim_id", *LOCATION_FEATURES), attributes.select("claim_id", *ATTRIBUTE_FEATURES), "claim_id"
    )
    return _complete(combined, LOCATION_FEATURES + ATTRIBUTE_FEATURES)


def multigraph_features(claims: DataFrame, graph: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Model inputs with all six graph features."""
    return _joined(claims, graph, LOCATION_FEATURES + ATTRIBUTE_FEATURES, keep)


def split_columns(df: DataFrame, ignore: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns, in column order, by declared type."""
    fields = [f for f in df.schema if f.name not in ignore]
    numeric = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    categorical = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return numeric, categorical


def feature_types(df: DataFrame) -> DataFrame:
    """Rows `column, kind, ordinal`, with the number of values each column holds."""
    numeric, categorical = split_columns(df)
    kinds = [(c, "numeric", i) for i, c in enumerate(numeric)]
    kinds += [(c, "categorical", i) for i, c in enumerate(categorical)]
    one_row = df.agg(*[F.count(c).alias(c) for c, _, _ in kinds])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kind).alias("kind"),
            F.lit(i).cast("long").alias("ordinal"),
            F.col(c).alias("row_values"),
        )
        for c, kind, i in kinds
    ]
    return one_row.select(F.inline(F.array(*rows)))
