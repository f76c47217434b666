import random

from pyspark.sql import functions as F

from chaptermill.plans import skew


def test_hot_keys(spark):
    df = spark.createDataFrame([(1,)] * 70 + [(2,)] * 11 + [(3,)] * 10 + [(None,)] * 50, "k long")
    assert skew.hot_keys(df, "k", share=0.0, least=10) == {1: 7, 2: 2}
    assert skew.hot_keys(df, "k") == {} and skew.hot_keys(df.limit(0), "k") == {}


def test_join_is_the_plain_join(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([7] * 6 + [1, 2, 3, None, 99])) for i in range(300)]
    left = spark.createDataFrame(rows, "id long, a long")
    right = spark.createDataFrame([(k, f"s{k}") for k in (1, 2, 3, 7, 8)] + [(7, "again"), (None, "n")], "k long, s string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, F.col("a") == F.col("k"), how).collect()))
        for least in (10, 10_000):
            assert sorted(map(str, skew.split_join(left, right, "a", "k", "id", how, share=0.0, least=least).collect())) == want


def test_hot_rows_are_spread(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(4000).select("id", F.lit(7).cast("long").alias("a"))
        right = spark.createDataFrame([(7, "x")], "k long, s string")
        sizes = [len(p) for p in skew.split_join(left, right, "a", "k", "id", share=0.0, least=50).select("id").rdd.glom().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
