import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import riskloom.exchange as exchange
from riskloom.operators.encoding import ClaimEncoder, fit_numeric
from riskloom.operators.features import amount_features, date_features, hour_cycle


def test_medians_and_moments(spark):
    rng = np.random.default_rng(3)
    n = 30_001
    wide = rng.lognormal(5, 2, n).round(3)
    few = rng.integers(0, 4, n).astype(float)
    holes = np.where(rng.random(n) < 0.2, np.nan, rng.normal(0, 1, n))
    data = spark.createDataFrame(
        [(float(a), float(b), None if math.isnan(c) else float(c), 7.0, None) for a, b, c in zip(wide, few, holes)],
        "wide double, few double, holes double, same double, empty double",
    )
    for limit in [exchange.ONE_TASK_ROWS, 10]:
        got = {r["column"]: r for r in fit_numeric(data, data.columns).collect()}
        for name, values in [("wide", wide), ("few", few), ("holes", holes)]:
            median = np.nanmedian(values)
            filled = np.where(np.isnan(values), median, values)
            assert got[name]["median"] == median
            assert got[name]["mean"] == pytest.approx(filled.mean(), rel=1e-9)
            assert got[name]["stddev"] == pytest.approx(filled.std(), rel=1e-9)
        assert (got["same"]["stddev"], got["same"]["scale"]) == (0.0, 1.0)
        assert (got["empty"]["median"], got["empty"]["scale"]) == (0.0, 1.0)


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [1.0, 2.0, 10.0], [4.0, 1.0, 3.0, 2.0], [2.0] * 9 + [5.0] * 9])
def test_medians_of_few_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert fit_numeric(df, ["x"]).first()["median"] == np.median(values)


def training(spark):
    rows = []
    for i in range(60):
        rare = ["r1", "r2", "r3"][i % 3] if i < 6 else None
        rows.append((f"c{i}", float(i), "M" if i % 2 else "F", rare or ("a" if i < 30 else "b"), "one" if i < 3 else "main"))
    rows.append(("c60", None, None, None, None))
    return spark.createDataFrame(rows, "claim_id string, x double, sex string, city string, kind string")


@pytest.fixture(scope="module")
def encoder(spark):
    return ClaimEncoder.fit(training(spark), ["x"], ["sex", "city", "kind"])


def test_vocabulary(encoder):
    got = [tuple(r) for r in encoder.vocabulary.orderBy("position").select("column", "value", "train_count", "slot").collect()]
    # F and M are equally frequent: the smaller one stands in for the missing value.
    assert got == [
        ("sex", "F", 31, 0), ("sex", "M", 30, 1),
        ("city", "a", 24, 0), ("city", "b", 31, 1), ("city", None, 6, 2),
        ("kind", "main", 58, 0), ("kind", None, 3, 1),
    ]
    names = [r["name"] for r in encoder.feature_names().orderBy("position").collect()]
    assert names[0] == "numeric__x" and names[5] == "categorical__city_infrequent_sklearn"


def encode(encoder, spark, rows):
    df = spark.createDataFrame(rows, "claim_id string, x double, sex string, city string, kind string")
    out = encoder.assemble(df, ["claim_id"]).select("claim_id", vector_to_array("features").alias("v"))
    return {r["claim_id"]: r["v"] for r in out.collect()}


def test_vectors(encoder, spark):
    got = encode(encoder, spark, [
        ("known", 29.5, "M", "b", "main"),
        ("rare", 29.5, "F", "r2", "one"),
        ("unseen", 29.5, "other", "nowhere", "new"),
        ("missing", None, None, None, None),
    ])
    assert got["known"][1:] == [0, 1, 0, 1, 0, 1, 0]
    assert got["rare"][1:] == [1, 0, 0, 0, 1, 0, 1]
    assert got["unseen"][1:] == [0, 0, 0, 0, 1, 0, 1]  # no infrequent slot for sex
    assert got["missing"][1:] == [1, 0, 0, 1, 0, 1, 0]
    assert got["known"][0] == got["missing"][0] == 0.0  # the median is the mean


def test_salted_encoding_is_the_same(encoder, spark, monkeypatch):
    rows = [(f"k{i}", float(i), ["M", "F", None][i % 3], "a" if i % 2 else "zzz", "one") for i in range(50)]
    small = encode(encoder, spark, rows)
    monkeypatch.setattr(exchange, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exchange, "HOT_ROWS", 5)
    large = ClaimEncoder(encoder.numeric, encoder.categorical, encoder.stats, encoder.modes, encoder.vocabulary)
    assert encoder.labels and not large.labels
    assert encode(large, spark, rows) == small


def test_save_and_load(encoder, spark, tmp_path):
    encoder.save(str(tmp_path / "encoder"))
    loaded = ClaimEncoder.load(spark, str(tmp_path / "encoder"))
    rows = [("k", 3.25, "M", "r1", "main")]
    assert encode(loaded, spark, rows) == encode(encoder, spark, rows)


def test_row_features(spark):
    df = spark.createDataFrame(
        [("2024-06-15", 6, 10.0, 0.0, 5.0), ("2024-06-17", None, 10.0, 40.0, 0.0)],
        "incident_date string, incident_hour_of_the_day long, claimed_amount double, total_claim_amount double, premium double",
    ).withColumn("incident_date", F.to_date("incident_date"))
    saturday, monday = date_features(df).collect()
    assert (saturday["incident_day_of_week"], saturday["incident_is_weekend"]) == (5, 1)
    assert (monday["incident_day_of_week"], monday["incident_is_weekend"], monday["incident_day_of_year"]) == (0, 0, 169)
    assert hour_cycle(df).first()["incident_hour_sin"] == pytest.approx(1.0)
    plain = amount_features(df, use_premium=False).collect()
    assert [r["claim_to_total_ratio"] for r in plain] == [None, 0.25]
    assert [r["claim_difference_from_total"] for r in plain] == [-10.0, 30.0]
    by_premium = amount_features(df)
    assert "claim_to_total_ratio" not in by_premium.columns
    assert [r["claim_to_premium_ratio"] for r in by_premium.collect()] == [2.0, None]
