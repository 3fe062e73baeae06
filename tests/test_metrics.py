import random

import pytest

from riskloom.operators import metrics as m


def scored(spark, data):
    return spark.createDataFrame(data, "fraud_label boolean, score double")


def brute(data):
    """Average precision over distinct thresholds, and the share of ordered pairs."""
    positives = [s for y, s in data if y]
    negatives = [s for y, s in data if not y]
    ap, before = 0.0, 0
    for t in sorted({s for _, s in data}, reverse=True):
        tp, flagged = sum(s >= t for s in positives), sum(s >= t for _, s in data)
        ap += (tp - before) / len(positives) * tp / flagged
        before = tp
    auc = sum((p > n) + (p == n) / 2 for p in positives for n in negatives) / (len(positives) * len(negatives))
    return ap, auc


@pytest.mark.parametrize("levels,limit", [(7, 1_000_000), (1000, 1_000_000), (1000, 20), (1, 1_000_000)])
def test_ranking_equals_brute_force(spark, levels, limit):
    rng = random.Random(levels)
    data = [(rng.random() < 0.3, rng.randrange(levels) / levels) for _ in range(300)]
    row = m.ranking_metrics(scored(spark, data), one_task_rows=limit).first()
    ap, auc = brute(data)
    assert row["average_precision"] == pytest.approx(ap) and row["roc_auc"] == pytest.approx(auc)


def test_one_class_only(spark):
    row = m.ranking_metrics(scored(spark, [(False, 0.1), (False, 0.9)])).first()
    assert row["average_precision"] == 0.0 and row["roc_auc"] is None
    row = m.threshold_metrics(scored(spark, [(False, 0.1)])).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_threshold_is_inclusive(spark):
    row = m.threshold_metrics(scored(spark, [(True, 0.5), (False, 0.49999), (True, 0.2), (False, 0.7)])).first()
    assert (row["true_positives"], row["false_positives"], row["false_negatives"], row["true_negatives"]) == (1, 1, 1, 1)
    assert (row["precision"], row["flagged_percentage"]) == (0.5, 50.0)


def test_sweep_equals_single_thresholds(spark):
    rng = random.Random(2)
    df = scored(spark, [(rng.random() < 0.4, rng.randrange(41) / 40) for _ in range(200)])
    sweep = m.threshold_sweep(df).orderBy("threshold").collect()
    assert [r["threshold"] for r in sweep] == m.THRESHOLDS and len(sweep) == 19
    for row in sweep[::6]:
        assert row == m.threshold_metrics(df, row["threshold"]).first()


def test_best_threshold_breaks_ties(spark):
    sweep = spark.createDataFrame([(0.1, 0.5, 0.4), (0.3, 0.5, 0.6), (0.2, 0.5, 0.6), (0.9, 0.4, 1.0)], "threshold double, f1 double, recall double")
    assert m.best_threshold(sweep).first()["threshold"] == 0.2


def test_class_weight(spark):
    assert m.class_weight(scored(spark, [(True, 0.0)] + [(False, 0.0)] * 3)).first()["positive_weight"] == 3.0
    assert m.class_weight(scored(spark, [(False, 0.0)])).first()["positive_weight"] is None
