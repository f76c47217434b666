"""Plans and results where one key holds a third of all rows."""

from pyspark.sql import functions as F

from chaptermill.operators import contents as C
from chaptermill.operators import navigation as N


def test_latch_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("g"), F.col("id").alias("pos"), (F.col("id") % 7 == 6).alias("go"))
    got = C.from_first(df, "g", "pos", F.col("go")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    want = df.join(df.filter("go").groupBy("g").agg(F.min("pos").alias("p0")), "g").filter("pos >= p0").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_neighbours_spread_a_hot_group(spark):
    df = spark.range(4000).select(F.lit("g").alias("g"), F.col("id").alias("name"))
    placed = N.neighbours(df, "g", ["name"], ["name"])
    sizes = [len(p) for p in placed.select("ord").rdd.glom().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2500
    assert placed.filter((F.col("ord") != F.col("name") + 1) | (F.col("next_name") != F.col("name") + 1)).count() == 0


def test_contents_parse_is_narrow(spark):
    df = spark.createDataFrame([("toc 1", "1 a")], "style string, text string")
    assert "Exchange" not in C.parsed_contents(df)._jdf.queryExecution().executedPlan().toString()
