"""Train-only encoder: imputation, standardization, one-hot slots, sparse vectors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import exchange
from riskloom.exchange import key_counts, number_rows, running_totals, sized_join
from riskloom.fixed import INFREQUENT_NAME, MIN_CATEGORY_COUNT
from riskloom.session import materialize

STATS_SCHEMA = "column string, ordinal int, median double, mean double, stddev double, scale double"
MODES_SCHEMA = "column string, ordinal int, value string, train_count long"

# The quantile sketch is off by one row in 10,000 at most; the bracket is five times as wide.
SKETCH_ACCURACY = 10_000
BRACKET = [0.4995, 0.5005]


def _middle_values(train: DataFrame, brackets: dict[str, tuple[float, float]], counts: dict[str, int]) -> dict:
    """Exact medians of columns whose middle values lie between the given bounds.

    One pass counts the values below each bracket, one orders the distinct values
    within the brackets (about a thousandth of the rows).
    """
    columns = list(brackets)
    below = train.agg(*[F.count_if(F.col(c) < brackets[c][0]).alias(c) for c in columns]).first()
    inside = [
        F.when(F.col(c).between(*brackets[c]), F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")))
        for i, c in enumerate(columns)
    ]
    values = (
        train.select(F.explode(F.array_compact(F.array(*inside))).alias("x"))
        .groupBy(F.col("x.i").alias("i"), F.col("x.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = running_totals(values, [F.col("i"), F.col("v")], {"upto": "n"})
    starts = running.groupBy("i").agg(F.min(F.col("upto") - F.col("n")).alias("start"))  # one row per column
    ranks = running.join(F.broadcast(starts), "i").withColumn("rank", F.col("upto") - F.col("start"))
    lower, upper = F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, c in enumerate(columns):
        lower = F.when(F.col("i") == i, (counts[c] + 1) // 2 - below[c]).otherwise(lower)
        upper = F.when(F.col("i") == i, (counts[c] + 2) // 2 - below[c]).otherwise(upper)
    picked = ranks.groupBy("i").agg(
        F.min(F.when(F.col("rank") >= lower, F.col("v"))).alias("lower"),
        F.min(F.when(F.col("rank") >= upper, F.col("v"))).alias("upper"),
        F.min(lower).alias("at"),
    )
    medians = {}
    for row in picked.collect():
        if row["upper"] is None or row["at"] < 1:
            raise ArithmeticError(f"median of {columns[row['i']]} lies outside its bracket")
        medians[columns[row["i"]]] = (row["lower"] + row["upper"]) / 2
    return medians


def fit_numeric(train: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: exact median, and mean and population deviation after imputing it.

    The moments of the imputed column follow from those of its values and the number of
    missing ones. A column without variance is scaled by one.
    """
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    train = train.select(*[number[c].alias(c) for c in columns])
    measured = train.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.var_pop(c).alias(f"var_{c}") for c in columns],
        *[F.percentile_approx(c, BRACKET, SKETCH_ACCURACY).alias(f"mid_{c}") for c in columns],
    ).first()
    rows = measured["_rows"]
    medians, brackets, counts = {}, {}, {}
    for c in columns:
        counts[c] = measured[f"n_{c}"]
        low, high = measured[f"mid_{c}"] or (0.0, 0.0)  # a column without values is imputed with 0
        if low == high:
            medians[c] = low
        else:
            brackets[c] = (low, high)
    if brackets:
        medians.update(_middle_values(train, brackets, counts))

    stats = []
    for i, c in enumerate(columns):
        n, missing = counts[c], rows - counts[c]
        mean, variance = measured[f"mean_{c}"] or 0.0, measured[f"var_{c}"] or 0.0
        gap = medians[c] - mean
        mean_all = mean + gap * missing / rows if rows else 0.0
        variance_all = (variance * n + gap * gap * n * missing / rows) / rows if rows else 0.0
        deviation = variance_all**0.5
        stats.append((c, i, medians[c], mean_all, deviation, deviation or 1.0))
    return train.sparkSession.createDataFrame(stats, STATS_SCHEMA)


def standardized(stats: list) -> dict[str, Column]:
    """Per column, the expression for its imputed and standardized value."""
    out = {}
    for row in stats:
        value = F.col(row["column"]).cast("double")
        filled = F.coalesce(F.when(~F.isnan(value), value), F.lit(row["median"]))
        out[row["column"]] = (filled - row["mean"]) / row["scale"]
    return out


def standardize(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Replace the columns that `stats` describes (one row per column) by standardized values."""
    return df.withColumns(standardized(stats.orderBy("ordinal").collect()))


def category_counts(train: DataFrame, columns: list[str]) -> DataFrame:
    """Training rows per column and value, missing values included; written once."""
    pairs = [F.struct(F.lit(i).alias("ordinal"), F.col(c).alias("value")) for i, c in enumerate(columns)]
    counts = (
        train.select(F.inline(F.array(*pairs)))
        .groupBy("ordinal", "value")
        .agg(F.count(F.lit(1)).alias("train_count"))
    )
    return materialize(counts, "category_counts")


def fit_categorical(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, the smallest of equally frequent ones; its count
    includes the missing values that it replaces."""
    best = counts.groupBy("ordinal").agg(
        F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("train_count")).alias("negated"), F.col("value")))).alias("best"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("train_count"))), F.lit(0)).alias("missing"),
    )
    return best.where("best is not null").select(
        F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("ordinal") + 1).alias("column"),
        "ordinal",
        F.col("best.value").alias("value"),
        (F.col("missing") - F.col("best.negated")).alias("train_count"),
    )


def fit_vocabulary(
    counts: DataFrame, modes: DataFrame, columns: list[str], min_count: int = MIN_CATEGORY_COUNT
) -> DataFrame:
    """One row per one-hot slot: values seen at least `min_count` times in order, then
    one slot for all rarer values of the column, if it has any (its value is missing).

    `position` numbers the slots of all columns, `slot` those of one column.
    """
    # One row per column on the broadcast side.
    imputed = F.broadcast(modes.select("ordinal", F.col("value").alias("_mode"), F.col("train_count").alias("_n")))
    filled = (
        counts.where("value is not null")
        .join(imputed, "ordinal")
        .withColumn("train_count", F.when(F.col("value") == F.col("_mode"), F.col("_n")).otherwise(F.col("train_count")))
        .select("ordinal", "value", "train_count")
    )
    frequent = filled.where(F.col("train_count") >= min_count).withColumn("infrequent", F.lit(False))
    rare = (
        filled.where(F.col("train_count") < min_count)
        .groupBy("ordinal")
        .agg(F.sum("train_count").alias("train_count"))
        .select("ordinal", F.lit(None).cast("string").alias("value"), "train_count", F.lit(True).alias("infrequent"))
    )
    numbered = number_rows(
        frequent.unionByName(rare), [F.col("ordinal"), F.col("infrequent"), F.col("value")], "position"
    )
    starts = numbered.groupBy("ordinal").agg(F.min("position").alias("_start"))  # one row per column
    return numbered.join(F.broadcast(starts), "ordinal").select(
        F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("ordinal") + 1).alias("column"),
        "ordinal",
        "value",
        "infrequent",
        "train_count",
        (F.col("position") - F.col("_start")).alias("slot"),
        "position",
    )


@dataclass
class ClaimEncoder:
    """Encoder fitted on training rows: per-column statistics and a vocabulary table."""

    numeric: list[str]
    categorical: list[str]
    stats: list
    modes: dict[str, str]
    vocabulary: DataFrame
    slots: int = 0
    rare_slots: dict[str, tuple[int, int]] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    column_slots: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        size = F.count(F.lit(1)) * 64 + F.coalesce(F.sum(F.octet_length("value")), F.lit(0))
        about = self.vocabulary.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("start"), size.alias("bytes")).collect()
        found = {r["column"]: r for r in about}
        self.column_slots = {c: found[c]["n"] if c in found else 0 for c in self.categorical}  # in the order of positions
        self.starts = {c: r["start"] for c, r in found.items()}
        self.slots = sum(self.column_slots.values())
        rare = self.vocabulary.where("infrequent").collect()  # one row per column at most
        self.rare_slots = {r["column"]: (r["slot"], r["position"]) for r in rare}
        # Columns whose values fit the bound of a broadcast together, smallest first.
        small, left = [], exchange.BROADCAST_BYTES
        for r in sorted(about, key=lambda r: (r["bytes"], r["column"])):
            left -= r["bytes"]
            if left >= 0 and r["column"] in self.modes:
                small.append(r["column"])
        values = self.vocabulary.where(F.col("column").isin(small) & ~F.col("infrequent")).orderBy("position").select("column", "value").collect()
        self.labels = {c: [r["value"] for r in values if r["column"] == c] for c in small}

    @classmethod
    def fit(
        cls, train: DataFrame, numeric: list[str], categorical: list[str], min_count: int = MIN_CATEGORY_COUNT
    ) -> "ClaimEncoder":
        stats = fit_numeric(train, numeric).collect()
        counts = category_counts(train, categorical)
        modes = fit_categorical(counts, categorical)
        vocabulary = materialize(fit_vocabulary(counts, modes, categorical, min_count), "vocabulary")
        return cls(numeric, categorical, stats, {r["column"]: r["value"] for r in modes.collect()}, vocabulary)

    @property
    def width(self) -> int:
        return len(self.numeric) + self.slots

    def feature_names(self) -> DataFrame:
        """Rows `position, name`, numeric features first."""
        spark = self.vocabulary.sparkSession
        numeric = spark.createDataFrame([(i, f"numeric__{c}") for i, c in enumerate(self.numeric)], "position long, name string")
        label = F.coalesce("value", F.lit(INFREQUENT_NAME))
        return numeric.unionByName(
            self.vocabulary.select(
                (F.col("position") + len(self.numeric)).cast("long").alias("position"),
                F.concat(F.lit("categorical__"), F.col("column"), F.lit("_"), label).alias("name"),
            )
        )

    def encode_onehot(self, df: DataFrame, key: str = "claim_id") -> DataFrame:
        """Replace each categorical column by a struct of its slot and position: rare and
        unseen values take the column's infrequent slot, or none if it has no such slot.

        Columns with few values are looked up together in the pass that reads the rows; a
        column whose values are too many to be sent to all tasks is joined, salted."""
        slot = "struct<slot:bigint,position:bigint>"
        known = [c for c in self.categorical if c in self.modes]
        source, columns = df, df.columns
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(self.modes[c])) for c in known})
        small = [c for c in known if self.labels.get(c)]
        if small:
            # A value without a slot of its own has the number behind the last label.
            index = StringIndexerModel.from_arrays_of_labels([self.labels[c] for c in small], small, [f"_index_{c}" for c in small], "keep")
            df = index.transform(df)
        made = {c: F.lit(None).cast(slot) for c in self.categorical}
        for c in known:
            rare = F.lit(None)
            if c in self.rare_slots:
                number, position = self.rare_slots[c]
                rare = F.struct(F.lit(number).cast("long").alias("slot"), F.lit(position).cast("long").alias("position"))
            if c in small:
                number = F.col(f"_index_{c}").cast("long")
                found = F.when(number < len(self.labels[c]), F.struct(number.alias("slot"), (number + self.starts[c]).alias("position")))
            elif c in self.labels:
                found = F.lit(None)  # all its values are rare
            else:
                filled = F.coalesce(F.col(c), F.lit(self.modes[c])).alias(c)
                values = self.vocabulary.where((F.col("column") == c) & ~F.col("infrequent")).select(F.col("value").alias(c), F.struct("slot", "position").alias(f"_slot_{c}"))
                df = sized_join(df, values, c, key, False, key_counts(source.select(filled), c))
                found = F.col(f"_slot_{c}")
            made[c] = F.coalesce(found, rare).cast(slot)
        return df.withColumns(made).select(*columns)

    def onehot_long(self, df: DataFrame, key: str = "claim_id") -> DataFrame:
        """Rows `key, column, slot, position, value`, one per filled slot."""
        entries = [
            F.when(
                F.col(c).isNotNull(),
                F.struct(F.lit(c).alias("column"), F.col(f"{c}.slot").alias("slot"), F.col(f"{c}.position").alias("position")),
            )
            for c in self.categorical
        ]
        encoded = self.encode_onehot(df.select(key, *self.categorical), key)
        return encoded.select(key, F.inline(F.array_compact(F.array(*entries)))).withColumn("value", F.lit(1.0))

    def nonzero_counts(self, df: DataFrame, key: str = "claim_id") -> DataFrame:
        """Rows `key, numeric_nonzero, onehot_nonzero, nonzero` of the assembled matrix."""
        encoded = self.encode_onehot(df, key).withColumns(standardized(self.stats))
        count = lambda flags: sum((x.cast("long") for x in flags), F.lit(0).cast("long"))
        numeric = count([F.abs(F.col(c)) > 1e-12 for c in self.numeric])
        onehot = count([F.col(c).isNotNull() for c in self.categorical])
        return encoded.select(
            key, numeric.alias("numeric_nonzero"), onehot.alias("onehot_nonzero"), (numeric + onehot).alias("nonzero")
        )

    def assemble(self, df: DataFrame, keep: list[str], key: str = "claim_id") -> DataFrame:
        """Columns `keep` and the sparse `features`: standardized numbers, then slots.

        Of the vocabulary the driver knows the number of slots per column only; a missing
        slot is the number behind the last, which the encoder leaves empty."""
        encoded = self.encode_onehot(df, key).withColumns(standardized(self.stats))
        inputs = list(self.numeric)
        sizes = {c: n for c, n in self.column_slots.items() if n}
        if sizes:
            slots = [f"_slot_{c}" for c in sizes]
            encoded = encoded.withColumns(
                {f"_slot_{c}": F.coalesce(F.col(f"{c}.slot"), F.lit(n)).cast("double") for c, n in sizes.items()}
            )
            last = self.vocabulary.sparkSession.createDataFrame([[float(n - 1) for n in sizes.values()]], slots)
            onehot = [f"_onehot_{c}" for c in sizes]
            encoder = OneHotEncoder(inputCols=slots, outputCols=onehot, handleInvalid="keep", dropLast=True)
            encoded = encoder.fit(last).transform(encoded)
            inputs += onehot
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(encoded).select(*keep, "features")

    def save(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.createDataFrame(self.stats, STATS_SCHEMA).write.mode("overwrite").parquet(f"{path}/stats")
        about = json.dumps({"numeric": self.numeric, "categorical": self.categorical, "modes": self.modes})
        spark.createDataFrame([(about,)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ClaimEncoder":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        stats = spark.read.parquet(f"{path}/stats").orderBy("ordinal").collect()
        vocabulary = spark.read.parquet(f"{path}/vocabulary")
        return cls(about["numeric"], about["categorical"], stats, about["modes"], vocabulary)
