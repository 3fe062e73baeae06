import pytest

from riskloom.operators import quality as q
from riskloom.operators.features import graph_features


def status(df):
    return {r["check"]: (r["violations"], r["status"]) for r in df.collect()}


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 3)], "k string, v int")
    assert status(q.check_unique(df, "k")) == {"unique:k": (2, "fail")}
    assert status(q.check_duplicate_rows(df)) == {"duplicate_rows": (1, "fail")}
    assert status(q.check_not_null(df, ["k", "v"])) == {"not_null:k": (1, "fail"), "not_null:v": (1, "fail")}
    with pytest.raises(Exception, match="repeated key k"):
        q.one_to_one_join(df, df.selectExpr("k", "v as w"), "k").collect()
    joined = q.one_to_one_join(df, df.selectExpr("k", "v as w"), "k", "left")
    for read in (lambda: joined.count(), lambda: joined.select("v", "w").collect(), lambda: joined.where("v > 0").select("w").count()):
        with pytest.raises(Exception, match="repeated key k"):
            read()
    assert sorted(map(tuple, q.one_to_one_join(df.where("v = 2"), df.where("v = 2").selectExpr("k", "v as w"), "k").collect())) == [("a", 2, 2)]


def test_values(spark):
    df = spark.createDataFrame([("1.5", "2024-02-29"), ("x", "2023-02-29"), (None, None)], "n string, d string")
    assert status(q.check_numeric(df, ["n"])) == {"numeric:n": (2, "fail")}
    assert status(q.check_dates(df, ["d"])) == {"date:d": (2, "fail")}
    assert [tuple(r) for r in q.check_domain(df, "n", ["1.5"]).collect()] == [("x", 1)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert status(q.check_non_empty(empty)) == {"non_empty": (1, "fail")}
    assert status(q.check_unique(empty, "k")) == {"unique:k": (0, "pass")}
    assert q.missing_report(empty).collect() == []


def test_orphans_and_keys(spark):
    child = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), ("b",)], "k string")
    assert status(q.check_foreign_key(child, parent, "k")) == {"foreign_key:k": (3, "fail")}
    assert status(q.check_same_keys(child.dropna(), parent, "k")) == {"keys:left_only": (1, "fail"), "keys:right_only": (1, "fail")}
    parts = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    assert status(q.check_partition(parts, parent, "k")) == {
        "partition:overlap": (1, "fail"), "partition:uncovered": (1, "fail"), "partition:foreign": (1, "fail"),
    }


def test_counts_and_manifest(spark):
    claims = spark.createDataFrame([(True,), (False,), (False,)], "fraud_label boolean")
    assert status(q.check_counts(claims, "fraud_label", {True: 1, False: 1}))["count:fraud_label=false"] == (1, "fail")
    good = spark.createDataFrame(
        [(3, 3, 3, 1, 2)], "source_rows long, policy_rows long, claim_rows long, fraud_claims long, non_fraud_claims long"
    )
    assert {s for _, s in status(q.check_manifest(good, claims, claims, claims)).values()} == {"pass"}
    assert status(q.check_manifest(good.unionAll(good), claims, claims, claims))["manifest:records"] == (1, "fail")


def test_missing_graph_features_stop_the_job(spark):
    from riskloom.operators.normalize import canonical_claims, clean_raw
    from tests.test_normalize import raw

    claims = canonical_claims(clean_raw(raw(spark)))
    graph = spark.createDataFrame(
        [("CLM_OTHER", 1, 1)], "claim_id string, train_location_claim_count long, train_shared_location_degree long"
    )
    with pytest.raises(Exception, match="missing graph features"):
        graph_features(claims, graph).collect()
    with pytest.raises(Exception, match="missing graph features"):
        graph_features(claims, graph).select("incident_month").count()
