"""Ranking and threshold metrics of scored claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.exchange import ONE_TASK_ROWS, running_totals
from riskloom.fixed import FLAG_THRESHOLD
from riskloom.functions.numbers import ratio_or_zero

THRESHOLDS = [k * 5 / 100 for k in range(1, 20)]


def class_weight(df: DataFrame, label: str = "fraud_label") -> DataFrame:
    """Class counts and the weight of a positive row, negatives over positives."""
    counts = df.agg(F.count_if(F.col(label)).alias("positives"), F.count_if(~F.col(label)).alias("negatives"))
    return counts.withColumn("positive_weight", F.try_divide(F.col("negatives").cast("double"), F.col("positives")))


def ranking_metrics(
    scored: DataFrame, label: str = "fraud_label", score: str = "score", one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Exact average precision (step-wise) and area under the ROC curve; rows of equal
    score count together.

    Rows are counted per distinct score first, so running totals go over scores only.
    """
    groups = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label)).alias("hits"), F.count_if(~F.col(label)).alias("misses")
    )
    running = running_totals(groups, [F.desc("score")], {"tp": "hits", "fp": "misses"}, one_task_rows)
    tp, fp, hits, misses = F.col("tp"), F.col("fp"), F.col("hits"), F.col("misses")
    sums = running.agg(
        F.sum(hits).alias("positives"),
        F.sum(misses).alias("negatives"),
        F.sum(hits * (tp / (tp + fp))).alias("precision_sum"),
        F.sum((misses * (2 * tp - hits)).cast("double")).alias("area"),
    )
    return sums.select(
        F.coalesce("positives", F.lit(0)).alias("positives"),
        F.coalesce("negatives", F.lit(0)).alias("negatives"),
        ratio_or_zero(F.col("precision_sum"), F.col("positives")).alias("average_precision"),
        F.try_divide(F.col("area"), 2.0 * F.col("positives") * F.col("negatives")).alias("roc_auc"),
    )


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    flagged, total = tp + fp, tp + fp + fn + tn
    return {
        "precision": ratio_or_zero(tp.cast("double"), flagged),
        "recall": ratio_or_zero(tp.cast("double"), tp + fn),
        "f1": ratio_or_zero(2.0 * tp, 2 * tp + fp + fn),
        "flagged_percentage": ratio_or_zero(flagged * 100.0, total),
        "true_negatives": tn,
        "false_positives": fp,
        "false_negatives": fn,
        "true_positives": tp,
    }


def threshold_metrics(
    scored: DataFrame, threshold: float = FLAG_THRESHOLD, label: str = "fraud_label", score: str = "score"
) -> DataFrame:
    """Confusion matrix and rates at one threshold; a score at the threshold is flagged."""
    flag, truth = F.col(score) >= threshold, F.col(label)
    counts = scored.agg(
        F.count_if(flag & truth).alias("tp"),
        F.count_if(flag & ~truth).alias("fp"),
        F.count_if(~flag & truth).alias("fn"),
        F.count_if(~flag & ~truth).alias("tn"),
    )
    rates = _rates(*[F.col(c) for c in ["tp", "fp", "fn", "tn"]])
    return counts.select(F.lit(threshold).alias("threshold"), *[c.alias(name) for name, c in rates.items()])


def threshold_sweep(
    scored: DataFrame, thresholds: list[float] | None = None, label: str = "fraud_label", score: str = "score"
) -> DataFrame:
    """The metrics at each of a list of thresholds, from one pass.

    Rows are counted by the number of thresholds they reach, which leaves one row per
    step and class; each threshold then sums the steps above it.
    """
    steps = sorted(thresholds or THRESHOLDS)
    reached = F.lit(0)
    for t in steps:
        reached = reached + (F.col(score) >= t).cast("int")
    bins = scored.groupBy(reached.alias("bin")).agg(
        F.count_if(F.col(label)).alias("hits"), F.count_if(~F.col(label)).alias("misses")
    )
    zero = F.lit(0).cast("long")
    sums = [
        F.coalesce(F.sum(F.when(F.col("bin") >= k, F.col(c))), zero).alias(f"{c}_{k}")
        for k in range(len(steps) + 1)
        for c in ["hits", "misses"]
    ]
    one_row = bins.agg(*sums)
    rows = []
    for k, t in enumerate(steps, start=1):
        tp, fp = F.col(f"hits_{k}"), F.col(f"misses_{k}")
        rates = _rates(tp, fp, F.col("hits_0") - tp, F.col("misses_0") - fp)
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), *[c.alias(name) for name, c in rates.items()]))
    return one_row.select(F.inline(F.array(*rows)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of greatest F1, then recall, then lowest threshold."""
    return sweep.orderBy(F.desc("f1"), F.desc("recall"), "threshold").limit(1)
