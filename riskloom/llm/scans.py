"""Running totals within keys, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

# Rows of one range. A key with more of them is spread over several ranges.
RANGE_ROWS = 50_000


def place(df: DataFrame, order: list[str], range_rows: int | None = None) -> DataFrame:
    """Write `df` in ranges of about `range_rows` rows by `order`, whose first column is
    the key; adds `_range`. Only rows equal in all of `order` cannot be told apart."""
    ranges = df.count() // (range_rows or RANGE_ROWS) + 1
    dealt = df.repartitionByRange(ranges, *order) if ranges > 1 else df.repartition(1)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def running(placed: DataFrame, order: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add inclusive running totals within the key, `{new column: (how, value)}` with
    `how` one of sum and xor, in the order that `place` was given.

    Totals run within a range; a key that spans ranges gets what the ranges before it
    hold of it. There are fewer such keys in a range than two, so they may be broadcast.
    Keys must not be null.
    """
    key = order[0]
    fold = {"sum": F.sum, "xor": F.bit_xor}
    empty = {"sum": F.lit(0), "xor": F.lit(0)}
    within = Window.partitionBy("_range", key).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = placed.select("*", *[fold[how](value).over(within).alias(name) for name, (how, value) in totals.items()])

    ends = placed.groupBy("_range").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("ends"))
    spread = ends.select(F.explode("ends").alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    spread = materialize(spread, "spread")
    if spread.isEmpty():
        return here
    parts = placed.join(F.broadcast(spread), key).groupBy(key, "_range").agg(*[fold[how](value).alias(name) for name, (how, value) in totals.items()])
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(key, "_range", *[F.coalesce(fold[how](name).over(before), empty[how]).alias(f"_before_{name}") for name, (how, _) in totals.items()])
    offsets = materialize(offsets, "offsets")
    join = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    whole = {name: join[how](F.col(name), F.coalesce(f"_before_{name}", empty[how])).alias(name) for name, (how, _) in totals.items()}
    return here.join(F.broadcast(offsets), [key, "_range"], "left").select(*placed.columns, *whole.values())
