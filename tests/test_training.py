"""Boosting stops by patience and keeps the best round."""

import random
import threading
from types import SimpleNamespace

from pyspark.ml.feature import VectorAssembler

from riskloom import session
from riskloom.operators import training
from riskloom.plans import models


def vectors(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        x, y = rng.random(), rng.random()
        fraud = (x + y + rng.gauss(0, 0.25)) > 1.25
        rows.append((f"c{k}", x, y, fraud, "train" if k % 3 else "validation"))
    df = spark.createDataFrame(rows, "claim_id string, x double, y double, fraud_label boolean, split string")
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)


def test_patience(spark):
    rows = vectors(spark)
    model, history = training.train_gbt(rows, max_iter=40, patience=4)
    best = max(range(len(history)), key=history.__getitem__) + 1
    assert model.getNumTrees == best > 1
    assert len(history) == min(40, best + 4)
    held_out = rows.where("split = 'validation'").selectExpr("claim_id", "features", "cast(fraud_label as double) label")
    again, _ = training.prefix_precision(model, held_out, at_once=3)
    assert [round(x, 9) for x in again] == [round(x, 9) for x in history[:best]]


def test_precision_of_prefixes(spark):
    """Against a plain ranking of the first tree's answers."""
    rows = vectors(spark)
    model, history = training.train_gbt(rows, max_iter=2, patience=1, fit_rows=500)
    held_out = rows.where("split = 'validation'")
    scored = model.trees[0].setPredictionCol("prediction").transform(held_out).select("prediction", "fraud_label").collect()
    hits = shown = 0
    total, positives = 0.0, sum(r["fraud_label"] for r in scored)
    for value in sorted({r["prediction"] for r in scored}, reverse=True):
        own = [r["fraud_label"] for r in scored if r["prediction"] == value]
        hits, shown = hits + sum(own), shown + len(own)
        total += sum(own) * hits / shown
    assert abs(history[0] - total / positives) < 1e-9


def test_first_trees(spark, tmp_path):
    """A prefix scores as a fit of so few rounds does, is saved and loaded, and leaves the whole as it is."""
    rows = vectors(spark).withColumn("label", training.F.col("fraud_label").cast("double"))
    learner = training.GBTClassifier(maxIter=6, seed=3, subsamplingRate=0.8, featureSubsetStrategy="0.5")
    whole, short = learner.fit(rows), learner.setMaxIter(4).fit(rows)
    kept = training.first_trees(whole, 4)
    assert kept.getNumTrees == 4 and whole.getNumTrees == 6
    score = lambda m: [round(r["probability"][1], 12) for r in m.transform(rows).orderBy("claim_id").collect()]
    assert score(kept) == score(short)
    kept.save(str(tmp_path / "kept"))
    assert score(training.GBTClassificationModel.load(str(tmp_path / "kept"))) == score(short)


def test_more_rounds(spark, monkeypatch):
    """Where the first fit is too short, the next looks at its new rounds only, with the same history."""
    rows = vectors(spark)
    _, history = training.train_gbt(rows, max_iter=60, patience=12)
    seen = []
    inner = training.prefix_precision
    monkeypatch.setattr(training, "prefix_precision", lambda *a: seen.append(a[3]) or inner(*a))
    monkeypatch.setattr(training, "min", lambda a, b: 5 if b > 20 and not seen else sorted((a, b))[0], raising=False)
    model, again = training.train_gbt(rows, max_iter=60, patience=12)
    assert [round(x, 9) for x in again] == [round(x, 9) for x in history] and len(seen) > 1 and seen[1] == 5


def test_feature_sets_train_at_once(spark, monkeypatch):
    """All sets are in training together, and give a row each in their order."""
    together = threading.Barrier(len(training.FEATURE_SETS), timeout=60)

    def train(claims, feature_set, fit_rows):
        together.wait()
        scored = claims.selectExpr("claim_id", "fraud_label", "id / 10 AS fraud_risk_score", "'test' AS split")
        trees = SimpleNamespace(getNumTrees=1)
        return SimpleNamespace(score=lambda rows, keep: rows, rounds_asked=3, history=[0.1, 0.2], trees=trees), scored

    claims = spark.range(10).selectExpr("id", "'c' || id AS claim_id", "id % 3 = 0 AS fraud_label")
    monkeypatch.setattr(models.fx, "split_table", lambda s, d: claims)
    monkeypatch.setattr(training, "train_scorer", train)
    rows = models.gbt_scores(spark, "").collect()
    assert [r["feature_set"] for r in rows] == list(training.FEATURE_SETS)
    assert {(r["positives"], r["negatives"], r["rounds_trained"]) for r in rows} == {(4, 6, 2)}


def test_threads_keep_their_tables(spark):
    """What one thread writes is not deleted by `written_only` of another."""
    other = []

    def write():
        other.append(session.materialize(spark.range(3), "other"))

    def make():
        one = threading.Thread(target=write)
        one.start()
        one.join()
        return session.materialize(spark.range(2), "own")

    session.written_only(make)
    assert other[0].count() == 3
