import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.fixed import RAW_COLUMNS
from riskloom.operators import normalize as n
from riskloom.operators.quality import DataQualityError


def test_location_key_halves(spark, rows):
    df = spark.createDataFrame([("OH", "X"), (None, "X"), ("OH", None), (None, None)], "s string, c string")
    keys = [r[0] for r in df.select(n.location_key(F.col("s"), F.col("c"))).collect()]
    assert keys == ["OH|X", "|X", "OH|", None]


def test_trim_all_white_space(spark):
    texts = ["  a b ", " a ", "\x1c\ta\x85\n", "　", "", None, "a​"]
    got = [r[0] for r in n.trim_strings(spark.createDataFrame([(t,) for t in texts], "t string")).collect()]
    assert got == [t if t is None else t.strip() for t in texts]


def raw(spark, **values):
    row = {c: None for c in RAW_COLUMNS}
    row.update(policy_id="POL1", incident_date="2024-06-13", fraud_reported="Y", policy_deductible=500, **values)
    from riskloom.fixed import RAW_SCHEMA

    return spark.createDataFrame([tuple(row[c] for c in RAW_COLUMNS)], RAW_SCHEMA)


def test_canonical_tables(spark):
    cleaned = n.clean_raw(raw(spark, incident_city=" Charlesville "))
    claim = n.canonical_claims(cleaned, "source").first()
    assert claim["claim_id"] == "CLM_POL1" and claim["claim_date"] == claim["incident_date"] == datetime.date(2024, 6, 13)
    assert claim["fraud_label"] is True and claim["incident_city"] == "Charlesville" and claim["source_dataset"] == "source"
    assert len(claim) == 29
    policy = n.canonical_policies(cleaned)
    assert len(policy.columns) == 9 and policy.first()["deductible"] == 500.0
    assert n.export_dates(n.canonical_claims(cleaned)).first()["claim_date"] == "2024-06-13"


def test_unreadable_rows_are_refused(spark):
    n.reject_bad_rows(raw(spark))
    assert n.bad_rows(raw(spark)).count() == 0
    odd = raw(spark).withColumn("incident_date", F.lit("13.06.2024")).withColumn("fraud_reported", F.lit("maybe"))
    assert sorted(tuple(r)[1:] for r in n.bad_rows(odd).collect()) == [("fraud_reported", "maybe"), ("incident_date", "13.06.2024")]
    with pytest.raises(Exception, match="cannot be read"):
        n.clean_raw(odd).select("incident_date", "fraud_label").collect()
    for read in [lambda c: c.count(), lambda c: n.canonical_policies(c).collect(), lambda c: n.canonical_claims(c).count(), lambda c: n.canonical_claims(c).select("incident_city").collect()]:
        for bad in (odd, odd.withColumn("incident_date", F.lit("2024-06-13")), odd.withColumn("fraud_reported", F.lit("N"))):
            with pytest.raises(Exception, match="cannot be read"):
                read(n.clean_raw(bad))
    assert n.clean_raw(odd, strict=False).first()["incident_date"] is None
    german = odd.withColumn("fraud_reported", F.lit("Y"))
    assert str(n.clean_raw(german, formats=["dd.MM.yyyy"]).first()["incident_date"]) == "2024-06-13"
    with pytest.raises(DataQualityError, match="incident_date"):
        n.reject_bad_rows(raw(spark).withColumn("incident_date", F.lit("13.06.2024?")))
    for label in ["maybe", None]:
        with pytest.raises(DataQualityError, match="label"):
            n.reject_bad_rows(raw(spark).withColumn("fraud_reported", F.lit(label).cast("string")))


def test_drop_ignores_absent_names(spark):
    assert n.drop_columns(spark.range(1).withColumn("a", F.lit(1)), ["a", "b"]).columns == ["id"]


def test_dates_are_parsed_once(spark):
    """The guard reads the parsed columns and is not moved below them."""
    plan = n.canonical_claims(n.clean_raw(raw(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast(") == 1 and plan.index("raise_error") < plan.index("try_cast(")
