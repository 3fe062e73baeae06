"""Data-quality checks. A check yields rows `check, violations, status`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.exchange import rows_as_report


class DataQualityError(ValueError):
    """A guarded operator met data that breaks its contract."""


def _with_status(counts: DataFrame) -> DataFrame:
    return counts.select(
        "check",
        F.col("violations").cast("long").alias("violations"),
        F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("status"),
    )


def count_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All row-wise checks of a table in one aggregation pass: `{name: is violated}`."""
    one_row = df.agg(*[F.count_if(broken).alias(f"v{i}") for i, broken in enumerate(checks.values())])
    named = [(name, f"v{i}") for i, name in enumerate(checks)]
    return _with_status(rows_as_report(one_row, named, ("check", "violations")))


def require(report: DataFrame) -> None:
    """Raise if any check of a report failed."""
    failed = [f"{r['check']}: {r['violations']}" for r in report.where("status = 'fail'").limit(20).collect()]
    if failed:
        raise DataQualityError("; ".join(failed))


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Present, missing and unexpected columns, with the number of values each holds."""
    present = [c for c in required if c in df.columns]
    unexpected = [c for c in df.columns if c not in required]
    missing = [c for c in required if c not in df.columns]
    states = {**dict.fromkeys(present, "present"), **dict.fromkeys(unexpected, "unexpected")}
    one_row = df.agg(
        *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(states)],
        *[F.lit(0).cast("long").alias(f"n{i + len(states)}") for i in range(len(missing))],
    )
    states.update(dict.fromkeys(missing, "missing"))
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(state).alias("state"), F.col(f"n{i}").alias("row_values"))
        for i, (c, state) in enumerate(states.items())
    ]
    return one_row.select(F.inline(F.array(*rows)))


def check_non_empty(df: DataFrame) -> DataFrame:
    """Reads at most one row."""
    found = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return _with_status(found.select(F.lit("non_empty").alias("check"), (1 - F.col("n")).alias("violations")))


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return count_violations(df, {f"not_null:{c}": F.col(c).isNull() for c in columns})


def _surplus(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    groups = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    total = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"))
    return _with_status(total.select(F.lit(name).alias("check"), "violations"))


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key."""
    return _surplus(df, [key], f"unique:{key}")


def check_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    return _surplus(df, df.columns, "duplicate_rows")


def check_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Offending values with their row counts; null has its own check."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def check_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that are missing or not numbers."""
    return count_violations(df, {f"numeric:{c}": F.col(c).try_cast("double").isNull() for c in columns})


def check_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that are missing or not dates."""
    return count_violations(df, {f"date:{c}": F.col(c).try_cast("date").isNull() for c in columns})


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent of the rows."""
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    one_row = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("missing"),
            F.round(F.try_divide(F.col(f"n{i}") * 100.0, F.col("_rows")), 6).alias("percent"),
        )
        for i, c in enumerate(df.columns)
    ]
    return one_row.select(F.inline(F.array(*rows))).where("missing > 0")


def class_distribution(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Rows and percent of each label, in the whole table or per group."""
    groups = [by] if by else []
    counts = df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("row_count"))
    if by:
        totals = counts.groupBy(by).agg(F.sum("row_count").alias("_total"))
        counts = counts.join(totals, by)
    else:
        counts = counts.withColumn("_total", counts.agg(F.sum("row_count")).scalar())
    percent = F.round(F.try_divide(F.col("row_count") * 100.0, F.col("_total")), 6)
    return counts.select(*groups, label, "row_count", percent.alias("percent"))


def check_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Difference of each table's row count from the first table's."""
    names = list(tables)
    counted = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n")
            for i, df in enumerate(tables.values())
        ],
    )
    one_row = counted.agg(*[F.sum(F.when(F.col("i") == i, F.col("n"))).alias(f"n{i}") for i in range(len(names))])
    one_row = one_row.select(*[F.abs(F.col(f"n{i}") - F.col("n0")).alias(f"v{i}") for i in range(1, len(names))])
    named = [(f"row_count:{names[i]}", f"v{i}") for i in range(1, len(names))]
    return _with_status(rows_as_report(one_row, named, ("check", "violations")))


def check_foreign_key(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent. Children are counted per key before the
    join, so a hot key crosses the network once."""
    counted = child.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    orphans = counted.join(parent.select(key), key, "left_anti")
    total = orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations"))
    return _with_status(total.select(F.lit(f"foreign_key:{key}").alias("check"), "violations"))


def check_counts(df: DataFrame, column: str, expected: dict) -> DataFrame:
    """Distance of each value's row count from the expected count."""
    one_row = df.agg(
        *[F.abs(F.count_if(F.col(column) == value) - n).alias(f"v{i}") for i, (value, n) in enumerate(expected.items())]
    )
    named = [(f"count:{column}={str(value).lower()}", f"v{i}") for i, value in enumerate(expected)]
    return _with_status(rows_as_report(one_row, named, ("check", "violations")))


def check_manifest(manifest: DataFrame, raw: DataFrame, policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Distance of each recorded count from the count recomputed on the tables."""
    one = F.lit(1)

    def counted(df: DataFrame, **values: Column) -> DataFrame:
        return df.agg(*[value.alias(name) for name, value in values.items()])

    parts = {
        "source_rows": counted(raw, n=F.count(one)),
        "policy_rows": counted(policies, n=F.count(one)),
        "claim_rows": counted(claims, n=F.count(one)),
        "fraud_claims": counted(claims, n=F.count_if(F.col("fraud_label"))),
        "non_fraud_claims": counted(claims, n=F.count_if(~F.col("fraud_label"))),
    }
    actual = {name: part.scalar() for name, part in parts.items()}
    recorded = manifest.agg(
        F.abs(F.count(one) - 1).alias("records"), *[F.first(name).alias(name) for name in parts]
    )
    one_row = recorded.select(
        F.col("records").alias("v_records"),
        *[F.coalesce(F.abs(F.col(name) - actual[name]), F.lit(1)).alias(f"v_{name}") for name in parts],
    )
    named = [(f"manifest:{name}", f"v_{name}") for name in ["records", *parts]]
    return _with_status(rows_as_report(one_row, named, ("check", "violations")))


def check_same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only. Both sides meet in one aggregation, reduced to
    distinct keys before the shuffle."""
    tagged = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    sides = tagged.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    one_row = sides.agg(
        F.count_if(F.col("_b") == 0).alias("left_only"), F.count_if(F.col("_a") == 0).alias("right_only")
    )
    named = [("keys:left_only", "left_only"), ("keys:right_only", "right_only")]
    return _with_status(rows_as_report(one_row, named, ("check", "violations")))


def check_partition(parts: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """The parts hold every key of the full table exactly once, and no other."""
    tagged = parts.select(key, F.lit(1).alias("_part"), F.lit(0).alias("_full")).unionAll(
        full.select(key, F.lit(0).alias("_part"), F.lit(1).alias("_full"))
    )
    keys = tagged.groupBy(key).agg(F.sum("_part").alias("_part"), F.sum("_full").alias("_full"))
    one_row = keys.agg(
        F.count_if(F.col("_part") > 1).alias("overlap"),
        F.count_if((F.col("_part") == 0) & (F.col("_full") > 0)).alias("uncovered"),
        F.count_if((F.col("_part") > 0) & (F.col("_full") == 0)).alias("foreign"),
    )
    named = [(f"partition:{c}", c) for c in ["overlap", "uncovered", "foreign"]]
    return _with_status(rows_as_report(one_row, named, ("check", "violations")))


def stop_on(df: DataFrame, bad: Column, said: Column | str) -> DataFrame:
    """The rows as they are; a row where `bad` holds stops the job, in the same pass.

    The test is a filter, so it is made whatever columns are read, by a count too. It
    depends on a row number, which keeps the optimizer from moving it to where `bad`
    would be computed once more, and from trying it on a row of nulls.
    """
    message = F.lit(said) if isinstance(said, str) else said
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.where(F.when(bad & (F.col("_row") >= 0), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_row")


def one_to_one_join(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join two tables whose key is unique on both sides; a repeated key stops the job.

    Rows per key are counted where the join has them sorted by key, so neither table is
    read or shuffled once more for the check. The check is made whatever columns are read.
    """
    each = Window.partitionBy(key)
    left, right = a.withColumn("_left_rows", F.count(F.lit(1)).over(each)), b.withColumn("_right_rows", F.count(F.lit(1)).over(each))
    joined = left.join(right, key, how)
    repeated = (F.col("_left_rows") > 1) | (F.col("_right_rows") > 1)
    said = F.concat(F.lit(f"repeated key {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("missing")))
    return stop_on(joined, repeated, said).drop("_left_rows", "_right_rows")


def any_missing(columns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(c).isNull() for c in columns])


def check_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with any of the columns missing."""
    return count_violations(df, {"complete": any_missing(columns)})


def check_schema_parity(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: its rows, its columns, and how many positions differ from the first table."""
    first = next(iter(tables.values())).columns
    reports = []
    for name, df in tables.items():
        differing = sum(1 for x, y in zip(first, df.columns) if x != y) + abs(len(first) - len(df.columns))
        reports.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table"),
                "row_count",
                F.lit(len(df.columns)).cast("long").alias("column_count"),
                F.lit(differing).cast("long").alias("violations"),
                F.lit("fail" if differing else "pass").alias("status"),
            )
        )
    return reduce(DataFrame.unionByName, reports)
