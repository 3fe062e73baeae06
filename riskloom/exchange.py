"""Joins, ranks and running totals that stay distributed under skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.session import materialize

# A key with more rows than this is hot: its rows are spread over several tasks. With more
# rows in all than HOT_ROWS * HOT_SHARE, the limit is that share of them, so that no more
# than HOT_SHARE keys can be hot.
HOT_ROWS = 1_000_000
HOT_SHARE = 100_000

# Lookup tables up to this size are broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024

# Tables up to this many rows are ordered in one task; larger ones are range partitioned.
ONE_TASK_ROWS = 1_000_000


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, as `key, n`."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(counts: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame | None:
    """The keys to be salted, with the number of tasks for each, or None if there are none.

    `counts` holds `key, n` for the side that will be spread. Every key over the limit is
    salted; the limit follows the rows, so at most HOT_SHARE of them come to the driver,
    whatever the size of the data, and the result may be broadcast.
    """
    limit = hot_rows or HOT_ROWS
    size = counts.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if size["most"] is None or size["most"] <= limit:
        return None
    if not hot_rows:
        limit = max(limit, size["rows"] // HOT_SHARE)
    hot = counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_copies"))
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def lookup_join(
    big: DataFrame, lookup: DataFrame, key: str, spread_by: str, hot: DataFrame | None, how: str = "left"
) -> DataFrame:
    """Join `big` with `lookup` (unique on `key`), salting the `hot` keys.

    A hot key's rows go to several tasks by a hash of `spread_by`, and its lookup row is
    repeated once per task; all other keys join as they are. A hot null key is spread
    too, though it finds nothing.
    """
    added = [c for c in lookup.columns if c != key]
    if hot is None:
        return big.join(lookup, key, how).select(*big.columns, *added)
    missing = hot.where(F.col(key).isNull()).first()
    null_copies = missing["_copies"] if missing else 1
    known = F.broadcast(hot.where(F.col(key).isNotNull()))
    place = F.xxhash64(spread_by)
    salted = big.join(known, key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), F.pmod(place, F.lit(null_copies)))
        .otherwise(F.pmod(place, F.coalesce("_copies", F.lit(1))))
        .cast("int"),
    )
    repeated = (
        lookup.join(known, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
        .drop("_copies")
    )
    return salted.join(repeated, [key, "_salt"], how).select(*big.columns, *added)


def fits_broadcast(lookup: DataFrame, key: str) -> bool:
    """Whether a written lookup table is small, by its rows and the bytes of its keys."""
    size = lookup.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes")
    ).first()
    return size["rows"] * 64 + size["bytes"] <= BROADCAST_BYTES


def sized_join(
    big: DataFrame, lookup: DataFrame, key: str, spread_by: str, small: bool, counts: DataFrame
) -> DataFrame:
    """Left join with a lookup table: broadcast if it was found small, else salted by the
    rows per key in `counts`."""
    if small:
        return big.join(F.broadcast(lookup), key, "left").select(*big.columns, *[c for c in lookup.columns if c != key])
    return lookup_join(big, lookup, key, spread_by, hot_keys(counts, key))


def running_totals(
    df: DataFrame,
    order: list[Column],
    totals: dict[str, str],
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add inclusive running sums of columns, `totals = {new column: summed column}`.

    `order` must be unique over the rows. A table over `one_task_rows` is range
    partitioned and written, so that the ranges are fixed; sums per range give each
    range its offset (one row per range), and only rows of one range share a task.
    """
    table = materialize(df, "ordered")
    rows = table.count()
    if rows <= one_task_rows:
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return table.select("*", *[F.sum(c).over(whole).alias(name) for name, c in totals.items()])

    ranges = rows // max(one_task_rows, 1) + 2
    placed = materialize(
        table.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_range").agg(*[F.sum(c).alias(name) for name, c in totals.items()])
    offsets = sums.select(
        "_range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}") for name in totals]
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per range, and the number of ranges is set above.
    return placed.join(F.broadcast(offsets), "_range").select(
        *table.columns,
        *[(F.sum(c).over(within) + F.col(f"_before_{name}")).alias(name) for name, c in totals.items()],
    )


def number_rows(df: DataFrame, order: list[Column], name: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Add a dense row number from 0 in `order`."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), order, {name: "_one"}, one_task_rows)
    return counted.withColumn(name, F.col(name) - 1).drop("_one")


def rows_as_report(one_row: DataFrame, values: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    """Turn named columns of a one-row aggregate into (label, value) rows."""
    label, value = names
    return one_row.select(
        F.inline(F.array(*[F.struct(F.lit(text).alias(label), F.col(c).alias(value)) for text, c in values]))
    )
