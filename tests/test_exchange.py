import random

from pyspark.sql import functions as F

from riskloom.exchange import hot_keys, key_counts, lookup_join, number_rows, running_totals


def table(spark):
    """One key with a third of the rows, many small ones, a key without lookup row, nulls."""
    rows = [(i, "hot") for i in range(300)] + [(300 + i, f"k{i % 97}") for i in range(400)]
    rows += [(700 + i, None) for i in range(150)] + [(850 + i, "unknown") for i in range(50)]
    return spark.createDataFrame(rows, "id int, key string")


def test_salted_join_equals_plain_join(spark, rows):
    big = table(spark)
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(97)], "key string, v int")
    for limit in [10, 40, 1000]:
        hot = hot_keys(key_counts(big, "key"), "key", limit)
        assert (hot is None) == (limit == 1000)
        for how in ["left", "inner"]:
            assert rows(lookup_join(big, lookup, "key", "id", hot, how)) == rows(
                big.join(lookup, "key", how).select("id", "key", "v")
            )


def test_hot_keys_get_copies_by_size(spark):
    found = {r["key"]: r["_copies"] for r in hot_keys(key_counts(table(spark), "key"), "key", 100).collect()}
    assert found == {"hot": 3, None: 2}


def test_running_totals_same_in_ranges(spark, rows):
    rng = random.Random(1)
    data = [(i, rng.randrange(50), rng.randrange(9)) for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(data, "id int, g int, n int")
    order = [F.col("g"), F.desc("id")]
    whole = rows(running_totals(df, order, {"upto": "n", "ids": "id"}))
    assert whole == rows(running_totals(df, order, {"upto": "n", "ids": "id"}, one_task_rows=40))
    expected, total = {}, 0
    for i, g, n in sorted(data, key=lambda r: (r[1], -r[0])):
        total += n
        expected[i] = total
    assert {r[0]: r[3] for r in whole} == expected


def test_number_rows(spark, rows):
    df = spark.createDataFrame([(c,) for c in "qwertyuiop"], "c string")
    for limit in [2, 100]:
        assert [r[0] for r in sorted(rows(number_rows(df, [F.col("c")], "i", limit)), key=lambda r: r[1])] == sorted("qwertyuiop")
