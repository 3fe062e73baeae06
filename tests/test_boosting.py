"""Trees are fitted on all rows, and are those of the library where nothing is drawn."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors

from riskloom.operators import boosting, training
from riskloom.plans import models

CITIES = 30


def vectors(spark, n=1500, values=20):
    """Two numbers and a place in a sparse vector; some numbers are zero, one place is dense."""
    rng, rows = random.Random(5), []
    for k in range(n):
        x, y = rng.randrange(values) / 4 - 2, rng.randrange(3)
        city = min(int(rng.expovariate(0.2)), CITIES - 1)
        fraud = x + y + (city % 4) + rng.gauss(0, 1.5) > 4
        filled = sorted([(0, x), (1, float(y)), (2 + city, 1.0)])
        rows.append((f"c{k}", Vectors.sparse(3 + CITIES, filled), fraud, "train" if k % 3 else "validation"))
    return spark.createDataFrame(rows, ["claim_id", "features", "fraud_label", "split"])


def fit_rows(rows):
    label = training.F.col("fraud_label")
    weight = training.F.when(label, 2.5).otherwise(1.0)
    return rows.select("claim_id", "features", label.cast("double").alias("label"), weight.alias("weight")).repartition(3)


def seen(model):
    """Rows at the root of each tree."""
    return [tree._java_obj.rootNode().impurityStats().rawCount() for tree in model.trees]


def test_all_rows_are_fitted_on(spark):
    """Whatever the size of a block: each tree draws its share of all rows, and the precision
    is that of all validation rows."""
    rows = vectors(spark)
    found = [training.train_gbt(rows, max_iter=6, patience=6, fit_rows=n) for n in (50, 10_000)]
    for model, history in found:
        assert all(0.8 * 1000 < n < 0.9 * 1000 for n in seen(model))
        assert [round(x, 9) for x in history] == [round(x, 9) for x in found[0][1]]
    held_out = rows.where("split = 'validation'").selectExpr("claim_id", "features", "cast(fraud_label as double) label")
    again, _ = training.prefix_precision(found[0][0], held_out)
    assert [round(x, 9) for x in again] == [round(x, 9) for x in found[0][1][: len(again)]]


@pytest.mark.parametrize("plan", ["scorer", "gbt_flags"])
def test_plans_fit_on_all_claims(spark, monkeypatch, plan):
    """The registered queries train on every training claim, and ask for no bound."""
    rows, given = vectors(spark), []
    fit = training.train_gbt

    def train(claims, feature_set, fit_rows=None, **_):
        given.append(fit(rows, max_iter=2, patience=2, fit_rows=fit_rows or 1)[0])
        raise InterruptedError

    monkeypatch.setattr(models.fx, "split_table", lambda s, d: rows)
    monkeypatch.setattr(training, "train_scorer", train)
    for module in (models, training):
        monkeypatch.setattr(module, "FIT_ROWS", 50, raising=False)
    with pytest.raises(InterruptedError):
        getattr(models, plan)(spark, "")
    assert all(0.8 * 1000 < n < 0.9 * 1000 for n in seen(given[0]))


def test_same_trees_as_the_library(spark):
    """With all rows and features in every tree, and few values; dense vectors as well."""
    rows = vectors(spark)
    train = fit_rows(rows)
    learner = GBTClassifier(weightCol="weight", maxDepth=4, stepSize=0.1, maxIter=5, subsamplingRate=1.0, featureSubsetStrategy="1.0", minInstancesPerNode=3, seed=3)
    wanted = learner.fit(train)
    dense = training.F.udf(lambda v: Vectors.dense(v.toArray()), wanted.transform(train).schema["features"].dataType)
    for given in (train, train.withColumn("features", dense("features"))):
        booster = boosting.Booster.on(learner, given, 200)
        booster.more(2)
        booster.more(3)
        model = booster.model()
        booster.close()
        shown = lambda m: [r["rawPrediction"][1] for r in m.transform(rows).orderBy("claim_id").collect()]
        assert np.allclose(shown(model), shown(wanted), atol=1e-9)
        assert np.allclose(model.featureImportances.toArray(), wanted.featureImportances.toArray(), atol=1e-9)
        assert [t.numNodes for t in model.trees] == [t.numNodes for t in wanted.trees]


def test_saved_trees(spark, tmp_path):
    train = fit_rows(vectors(spark, 300))
    learner = GBTClassifier(weightCol="weight", maxDepth=3, subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=3, seed=3)
    booster = boosting.Booster.on(learner, train, 200)
    booster.more(12)  # the margins are written on the way
    model = booster.model()
    booster.close()
    model.save(str(tmp_path / "model"))
    loaded = training.GBTClassificationModel.load(str(tmp_path / "model"))
    score = lambda m: [r["probability"][1] for r in m.transform(train).orderBy("claim_id").collect()]
    assert score(loaded) == score(model)


def test_thresholds_of_many_values():
    """Told by quantiles of all values, equally heavy within a fraction of a bin."""
    rng = np.random.default_rng(1)
    value = np.sort(rng.exponential(size=300_000))
    points = boosting._thinner(boosting._summed(np.zeros(len(value), np.int64), value, np.ones(len(value))), boosting.GATHERED)
    assert len(points[0]) <= boosting.POINTS and points[2].sum() == len(value)
    limits = boosting._thresholds(points[1], points[2], 32)
    heavy = np.diff(np.r_[0, np.searchsorted(value, limits), len(value)])
    assert len(limits) == 31 and heavy.min() > 0.95 * len(value) / 32 and heavy.max() < 1.05 * len(value) / 32
