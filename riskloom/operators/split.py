"""Reproducible stratified split, kept as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskloom.fixed import SPLIT_SEED

BUCKET_DIGITS = 4  # leading hex digits of the hash: at most 65,536 buckets per label


def stratified_split(
    df: DataFrame,
    key: str = "claim_id",
    label: str = "fraud_label",
    seed: int = SPLIT_SEED,
    holdout_percent: int = 15,
) -> DataFrame:
    """Add `split`: per label, exactly floor((p n + 50) / 100) rows in test, as many in
    validation, and the rest in train, by rank of a hash of seed and key.

    No row is shuffled. Counts per hash bucket (a table of bounded size) tell in which
    bucket each cut falls; only the rows of those buckets are ranked, which gives the
    hash value at each cut; every row then compares its own hash with its label's cuts.
    """
    if not isinstance(df.schema[label].dataType, T.BooleanType):
        raise TypeError(f"{label} must be boolean")
    group = F.coalesce(F.col(label).cast("int"), F.lit(-1))  # three values at most
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    keyed = df.select(group.alias("_group"), hashed.alias("_hash")).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )

    buckets = keyed.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_bucket = Window.partitionBy("_group").orderBy("_bucket")
    held = F.floor((holdout_percent * F.sum("_n").over(Window.partitionBy("_group")) + 50) / 100)
    upto = buckets.select(
        "_group", "_bucket", (F.sum("_n").over(by_bucket) - F.col("_n")).alias("_before"), "_n", held.alias("_held")
    )
    cuts = upto.select(
        "_group",
        "_bucket",
        F.explode(
            F.array(
                F.struct(F.lit("test").alias("name"), (F.col("_held") - F.col("_before")).alias("at")),
                F.struct(F.lit("validation").alias("name"), (F.col("_held") * 2 - F.col("_before")).alias("at")),
            )
        ).alias("_cut"),
        "_n",
    ).where("_cut.at between 1 and _n")

    # Two cuts per label: six rows at most.
    near = keyed.join(F.broadcast(cuts), ["_group", "_bucket"])
    by_hash = Window.partitionBy("_group", "_bucket", "_cut.name").orderBy("_hash")
    at_cut = near.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") == F.col("_cut.at"))
    cut_hashes = at_cut.groupBy("_group").agg(
        F.max(F.when(F.col("_cut.name") == "test", F.col("_hash"))).alias("_test_to"),
        F.max(F.when(F.col("_cut.name") == "validation", F.col("_hash"))).alias("_validation_to"),
    )

    split = (
        F.when(F.col("_hash") <= F.col("_test_to"), "test")
        .when(F.col("_hash") <= F.col("_validation_to"), "validation")
        .otherwise("train")
    )
    return (
        df.withColumns({"_group": group, "_hash": hashed})
        .join(F.broadcast(cut_hashes), "_group", "left")
        .select(*[F.col(f"`{c}`") for c in df.columns], split.alias("split"))
    )


def training_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def restrict(df: DataFrame, ids: DataFrame, key: str = "claim_id") -> DataFrame:
    """Rows whose key is among the given ids."""
    return df.join(ids.select(key), key, "left_semi")
