"""Queries over training, scoring and ranking evaluation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import metrics, training
from riskloom.operators.split import stratified_split
from riskloom.plans import fixtures as fx
from riskloom.plans.oracle import with_ctes
from riskloom.plans.registry import REGISTRY
from riskloom.session import scratch_path

add = REGISTRY.add


def scorer(s, d, feature_set="graph_enhanced"):
    return training.train_scorer(fx.split_table(s, d), feature_set, fit_rows=training.FIT_ROWS)


def gbt_scores(s, d):
    """Ranking quality on the test rows for each feature set, with the rounds of boosting.
    The sets are trained at the same time, as the short jobs of one leave cores idle."""
    claims = fx.split_table(s, d)

    def row(feature_set):
        model, features = training.train_scorer(claims, feature_set, fit_rows=training.FIT_ROWS)
        scored = model.score(features.where("split = 'test'"), ["claim_id", "fraud_label"])
        return metrics.ranking_metrics(scored, score="fraud_risk_score").withColumns(
            {
                "feature_set": F.lit(feature_set),
                "rounds_asked": F.lit(model.rounds_asked),
                "rounds_trained": F.lit(len(model.history)),
                "rounds_kept": F.lit(model.trees.getNumTrees),
            }
        )

    with ThreadPoolExecutor(len(training.FEATURE_SETS)) as pool:
        rows = [pool.submit(inheritable_thread_target(s)(row), feature_set) for feature_set in training.FEATURE_SETS]
        return reduce(DataFrame.unionByName, [r.result() for r in rows])


def gbt_flags(s, d):
    model, features = scorer(s, d)
    return model.score(features, ["claim_id"])


def model_roundtrip(s, d):
    """Scores before and after saving and loading: how many differ, lie outside 0 to 1, or
    have a flag that the threshold doesn't give; and whether the history is the same."""
    model, features = scorer(s, d, "baseline")
    path = scratch_path(s, "model")
    model.save(path)
    before = model.score(features, ["claim_id"]).select("claim_id", F.col("fraud_risk_score").alias("before"))
    loaded = training.ClaimScorer.load(s, path)
    after = loaded.score(features, ["claim_id"]).withColumnRenamed("fraud_risk_score", "after")
    joined = before.join(after, "claim_id")
    wrong = F.col("flagged_at_threshold") != (F.col("before") >= F.col("threshold"))
    return joined.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("before") != F.col("after")).alias("differing"),
        F.count_if(wrong).alias("wrong_flags"), F.count_if(~F.col("before").between(0, 1)).alias("outside"),
        F.max("threshold").alias("threshold"),
        F.lit(loaded.history == model.history).alias("same_history"),
    )


METRICS = ["precision", "recall", "f1", "flagged_percentage"]
COUNTS = ["true_negatives", "false_positives", "false_negatives", "true_positives"]


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in METRICS}).withColumn("threshold", F.round("threshold", 2))


def rates_sql(thresholds: str) -> str:
    return f"""SELECT round(threshold, 2) AS threshold,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 6) AS f1,
  round((tp + fp) * CAST(100 AS DOUBLE) / (tp + fp + fn + tn), 6) AS flagged_percentage,
  tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives
FROM (SELECT t.threshold, count(*) FILTER (score >= threshold AND fraud_label) AS tp,
  count(*) FILTER (score >= threshold AND NOT fraud_label) AS fp,
  count(*) FILTER (score < threshold AND fraud_label) AS fn,
  count(*) FILTER (score < threshold AND NOT fraud_label) AS tn
  FROM scored, {thresholds} GROUP BY t.threshold)"""


_sweep = "(SELECT CAST(k * 5 AS DOUBLE) / 100 AS threshold FROM range(1, 20) r(k)) t"

add(
    "class_weight",
    lambda s, d: metrics.class_weight(
        stratified_split(fx.claims(s, d).select("claim_id", "fraud_label")).where("split = 'train'")
    ).withColumn(
        "positive_weight", F.round("positive_weight", 6)
    ),
    with_ctes(
        "split",
        """SELECT count(*) FILTER (fraud_label) AS positives, count(*) FILTER (NOT fraud_label) AS negatives,
  round(count(*) FILTER (NOT fraud_label)::DOUBLE / count(*) FILTER (fraud_label), 6) AS positive_weight
FROM split WHERE split = 'train'""",
    ),
)
add(
    "ranking_metrics",
    lambda s, d: metrics.ranking_metrics(fx.scored(s, d)).withColumns(
        {c: F.round(c, 6) for c in ["average_precision", "roc_auc"]}
    ),
    with_ctes(
        "scored",
        """, g AS (SELECT score, count(*) FILTER (fraud_label) AS hits, count(*) FILTER (NOT fraud_label) AS misses
  FROM scored GROUP BY score),
r AS (SELECT *, sum(hits) OVER (ORDER BY score DESC) AS tp, sum(misses) OVER (ORDER BY score DESC) AS fp FROM g)
SELECT CAST(sum(hits) AS BIGINT) AS positives, CAST(sum(misses) AS BIGINT) AS negatives,
  round(sum(hits * (tp::DOUBLE / (tp + fp))) / sum(hits), 6) AS average_precision,
  round(sum(misses * (2 * tp - hits))::DOUBLE / (2.0 * sum(hits) * sum(misses))::DOUBLE, 6) AS roc_auc FROM r""",
    ),
)
add(
    "threshold_metrics",
    lambda s, d: rounded(metrics.threshold_metrics(fx.scored(s, d))),
    with_ctes("scored", rates_sql("(SELECT CAST(0.5 AS DOUBLE) AS threshold) t")),
)
add("threshold_sweep", lambda s, d: rounded(metrics.threshold_sweep(fx.scored(s, d))), with_ctes("scored", rates_sql(_sweep)))
add(
    "best_threshold",
    lambda s, d: rounded(metrics.best_threshold(metrics.threshold_sweep(fx.scored(s, d)))),
    with_ctes("scored", f"SELECT * FROM ({rates_sql(_sweep)}) ORDER BY f1 DESC, recall DESC, threshold LIMIT 1"),
)
add("gbt_scores", gbt_scores)
add("gbt_flags", gbt_flags)
add(
    "model_roundtrip",
    model_roundtrip,
    with_ctes(
        "claims",
        """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS wrong_flags, CAST(0 AS BIGINT) AS outside,
  CAST(0.5 AS DOUBLE) AS threshold, TRUE AS same_history FROM claims""",
    ),
)
