"""Training and scoring of class-weighted boosted trees."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.fixed import (
    ATTRIBUTE_FEATURES,
    CATEGORICAL,
    CLAIM_NUMERIC,
    DERIVED_NUMERIC,
    FLAG_THRESHOLD,
    LOCATION_FEATURES,
    SPLIT_SEED,
)
from riskloom.operators.boosting import Booster
from riskloom.operators.encoding import ClaimEncoder
from riskloom.operators.features import base_features, combine_graph_features, graph_features, multigraph_features
from riskloom.operators.graph import split_safe_attribute_features, split_safe_location_features
from riskloom.operators.metrics import class_weight
from riskloom.operators.quality import DataQualityError
from riskloom.session import materialize

# Numeric inputs per feature set, in column order.
FEATURE_SETS = {
    "baseline": CLAIM_NUMERIC + DERIVED_NUMERIC,
    "graph_enhanced": CLAIM_NUMERIC + LOCATION_FEATURES + DERIVED_NUMERIC,
    "multigraph": CLAIM_NUMERIC + LOCATION_FEATURES + ATTRIBUTE_FEATURES + DERIVED_NUMERIC,
}


def feature_table(claims: DataFrame, feature_set: str) -> DataFrame:
    """Model inputs of split claims for a feature set, with claim id, split and label."""
    keep = ("claim_id", "fraud_label")
    if feature_set == "baseline":
        return base_features(claims, keep)
    location = split_safe_location_features(claims)
    if feature_set == "graph_enhanced":
        return graph_features(claims, location, keep)
    if feature_set == "multigraph":
        return multigraph_features(claims, combine_graph_features(location, split_safe_attribute_features(claims)), keep)
    raise ValueError(f"unknown feature set: {feature_set}")


# Boosting ends when so many rounds have brought nothing on the validation rows.
PATIENCE = 50

# Training rows that a task looks at together; trees are fitted on all blocks of so many.
FIT_ROWS = 50_000


@dataclass
class ClaimScorer:
    """A fitted encoder and the trees trained on its vectors. `history` has the average
    precision on the validation rows after each round that was trained; of the rounds, as
    many are kept as `trees` has."""

    encoder: ClaimEncoder
    trees: GBTClassificationModel
    feature_set: str
    threshold: float = FLAG_THRESHOLD
    rounds_asked: int = 0
    history: list[float] = field(default_factory=list)

    def save(self, path: str) -> None:
        spark = self.encoder.vocabulary.sparkSession
        self.encoder.save(f"{path}/encoder")
        self.trees.write().overwrite().save(f"{path}/trees")
        about = spark.createDataFrame(
            [(self.feature_set, self.threshold, self.rounds_asked, self.history)],
            "feature_set string, threshold double, rounds_asked int, history array<double>",
        )
        about.write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ClaimScorer":
        about = spark.read.parquet(f"{path}/about").first()
        trees = GBTClassificationModel.load(f"{path}/trees")
        return cls(ClaimEncoder.load(spark, f"{path}/encoder"), trees, *about)

    def score(self, features: DataFrame, keep: list[str]) -> DataFrame:
        """Columns `keep` with score, threshold, flag and model tag, from a feature table."""
        vectors = self.encoder.assemble(features, keep)
        probability = vector_to_array(F.col("probability"))[1]
        scored = self.trees.transform(vectors).select(*keep, probability.alias("fraud_risk_score"))
        return scored.select(
            *keep,
            "fraud_risk_score",
            F.lit(self.threshold).alias("threshold"),
            (F.col("fraud_risk_score") >= self.threshold).alias("flagged_at_threshold"),
            F.lit(f"gbt_{self.feature_set}").alias("model"),
        )


def train_gbt(
    vectors: DataFrame, max_iter: int = 1000, patience: int = PATIENCE, fit_rows: int = FIT_ROWS, seed: int = SPLIT_SEED
) -> tuple[GBTClassificationModel, list[float]]:
    """Boosted trees on all training rows of `claim_id, features, fraud_label, split`, and the
    average precision on all validation rows after each round. Positives weigh negatives over
    positives; test rows are not seen.

    Boosting goes on until `patience` rounds in a row have not raised the precision, or for
    `max_iter` rounds; the rounds up to the highest are kept, as an ensemble of the first
    trees. Rounds are looked at some at a time, and where the best is too near the last, more
    are added. `fit_rows` is the size of a block, and has no part in the result but by rounding.
    """
    weight = class_weight(vectors.where("split = 'train'")).first()
    if not weight["positives"]:
        raise DataQualityError("no positive training rows")
    label = F.col("fraud_label")

    def rows(split: str) -> DataFrame:
        return vectors.where(F.col("split") == split).select(
            "claim_id", "features", label.cast("double").alias("label"), F.when(label, weight["positive_weight"]).otherwise(1.0).alias("weight")
        )

    train, held_out = materialize(rows("train"), "fit_rows"), materialize(rows("validation"), "held_out")
    learner = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxDepth=6,
        stepSize=0.05,
        subsamplingRate=0.85,
        featureSubsetStrategy="0.85",
        minInstancesPerNode=3,
        seed=seed,
    )
    rounds, history, margins = min(max_iter, patience + 25), [], None
    booster = Booster.on(learner, train, fit_rows)
    try:
        while True:
            booster.more(rounds - len(history))
            trees = booster.model()
            more, margins = prefix_precision(trees, held_out, margins, len(history))
            history += more
            # What a run with this patience would have seen.
            waited = next((k for k in range(rounds) if k + 1 - _highest(history, k) >= patience), None)
            if waited is not None or rounds == max_iter:
                break
            rounds = min(max_iter, rounds + 25)
    finally:
        booster.close()
    if waited is not None:
        history = history[: waited + 1]
    return first_trees(trees, _highest(history, len(history) - 1)), history


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first n trees of a fitted one, which stays as it is."""
    if n == model.getNumTrees:
        return model
    gateway, java = model._java_obj, SparkContext._gateway
    trees = java.new_array(java.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = java.new_array(java.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(gateway.trees()[:n], model.treeWeights[:n], strict=True)):
        trees[i], weights[i] = tree, weight
    kept = java.jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures, model.numClasses)
    return GBTClassificationModel(kept).setFeaturesCol(model.getFeaturesCol())


def _highest(history: list[float], upto: int) -> int:
    """The first round, from 1, with the highest value among those up to an index."""
    return max(range(upto + 1), key=history.__getitem__) + 1


def prefix_precision(
    model: GBTClassificationModel, rows: DataFrame, margins: DataFrame | None = None, start: int = 0, at_once: int = 50
) -> tuple[list[float], DataFrame]:
    """Average precision over `rows` of the first tree, the first two, and so on, and the
    rows with their margins after the last; from `start` on, with the margins up to there.

    A tree adds a column; sums over the trees give a margin per row and round. Rounds are
    looked at together, each ranked on its own; one number per round comes back.
    """
    trees, weights = model.trees, model.treeWeights
    before = rows.select("claim_id", "features", "label", F.lit(0.0).alias("_margin")) if margins is None else margins
    out: list[float] = []
    for first in range(start, len(trees), at_once):
        part = range(first, min(len(trees), first + at_once))
        added = before
        for i in part:
            added = trees[i].setFeaturesCol("features").setPredictionCol(f"_tree_{i}").transform(added)
        steps = F.array(*[F.col(f"_tree_{i}") * weights[i] for i in part])
        added = materialize(added.select("claim_id", "features", "label", "_margin", steps.alias("_steps")), "margins")
        upto = F.transform("_steps", lambda _, i: F.aggregate(F.slice("_steps", F.lit(1), i + 1), F.col("_margin"), lambda a, x: a + x))
        counts = added.select("label", F.posexplode(upto).alias("round", "margin")).groupBy("round", "margin")
        counts = counts.agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
        down = Window.partitionBy("round").orderBy(F.desc("margin"))
        ranked = counts.select("round", "hits", F.sum("hits").over(down).alias("tp"), F.sum("n").over(down).alias("shown"))
        found = ranked.groupBy("round").agg((F.sum(F.col("hits") * F.col("tp") / F.col("shown")) / F.sum("hits")).alias("ap"))
        out += [r["ap"] or 0.0 for r in found.orderBy("round").collect()] or [0.0] * len(part)
        total = F.aggregate("_steps", F.col("_margin"), lambda a, x: a + x)
        before = added.select("claim_id", "features", "label", total.alias("_margin"))
    return out, before


def train_scorer(
    claims: DataFrame, feature_set: str = "graph_enhanced", max_iter: int = 1000, fit_rows: int = FIT_ROWS
) -> tuple[ClaimScorer, DataFrame]:
    """Fit encoder and trees on split claims; also returns the written feature table."""
    features = materialize(feature_table(claims, feature_set), "model_features")
    encoder = ClaimEncoder.fit(features.where("split = 'train'"), FEATURE_SETS[feature_set], CATEGORICAL)
    vectors = materialize(encoder.assemble(features, ["claim_id", "split", "fraud_label"]), "vectors")
    trees, history = train_gbt(vectors, max_iter, fit_rows=fit_rows)
    return ClaimScorer(encoder, trees, feature_set, rounds_asked=max_iter, history=history), features


def find_claims(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Per wanted id, how many claims carry it; callers expect one. Claims are reduced to
    the wanted ids before they are counted."""
    wanted = ids.select("claim_id").distinct()
    found = claims.join(wanted, "claim_id", "left_semi").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    counted = wanted.join(found, "claim_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    state = F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous")
    return counted.select("claim_id", n.alias("matches"), state.alias("state"))


def find_graph_features(splits: list[DataFrame], ids: DataFrame) -> DataFrame:
    """Graph features of the wanted claims, looked up in the tables of all splits. An id
    that no table has is `missing`, with null features; one that several rows carry is
    `ambiguous`, and has a row for each."""
    union = splits[0]
    for other in splits[1:]:
        union = union.unionByName(other)
    wanted = ids.select("claim_id").distinct()
    found = union.join(wanted, "claim_id", "left_semi").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("claim_id")))
    joined = wanted.join(found, "claim_id", "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "found").otherwise("ambiguous")
    return joined.select(*union.columns, state.alias("state"))
