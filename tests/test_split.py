import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskloom.operators.split import restrict, stratified_split, training_rows


def expected(keys_by_label, seed=42):
    out = {}
    for keys in keys_by_label.values():
        ranked = sorted(keys, key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
        held = (15 * len(keys) + 50) // 100
        for i, k in enumerate(ranked):
            out[k] = "test" if i < held else "validation" if i < 2 * held else "train"
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 60), st.integers(0, 40), st.integers(0, 5))
def test_exact_membership(spark, negatives, positives, unknown):
    groups = {
        label: [f"{label}{i}" for i in range(n)] for label, n in [(False, negatives), (True, positives), (None, unknown)]
    }
    data = [(k, label) for label, keys in groups.items() for k in keys]
    df = spark.createDataFrame(data, "claim_id string, fraud_label boolean")
    got = {r["claim_id"]: r["split"] for r in stratified_split(df).collect()}
    assert got == expected(groups)


def test_large_and_independent_of_partitions(spark):
    df = spark.range(40_000).selectExpr("concat('c', id) AS claim_id", "id % 9 = 0 AS fraud_label")
    one = stratified_split(df.coalesce(1))
    many = stratified_split(df.repartition(13))
    assert one.exceptAll(many).isEmpty() and one.count() == 40_000
    counts = {(r["fraud_label"], r["split"]): r["count"] for r in one.groupBy("fraud_label", "split").count().collect()}
    for label, n in [(True, 4445), (False, 35555)]:
        held = (15 * n + 50) // 100
        assert counts[label, "test"] == counts[label, "validation"] == held
        assert counts[label, "train"] == n - 2 * held
    assert stratified_split(df, seed=7).exceptAll(one).count() > 0


def test_rejects_other_labels(spark):
    with pytest.raises(TypeError):
        stratified_split(spark.createDataFrame([("a", "Y")], "claim_id string, fraud_label string"))


def test_restrict(spark, rows):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "claim_id string, split string")
    assert rows(restrict(df, training_rows(df))) == [("a", "train")]
