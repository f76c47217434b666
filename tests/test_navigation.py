import random

import pytest
from pyspark.sql import functions as F

from chaptermill.operators import navigation as N


def test_three_files(spark):
    df = spark.createDataFrame([("d", "b.md", "Second"), ("d", "a.md", "First"), ("d", "c.md", "Third")], "g string, name string, title string")
    got = {r.name: (r.ord, r.prev_title, r.next_name) for r in N.neighbours(df, "g", ["name"], ["name", "title"]).collect()}
    assert got == {"a.md": (1, None, "b.md"), "b.md": (2, "First", "c.md"), "c.md": (3, "Second", None)}
    toc = [tuple(r)[1:] for r in N.contents_entries(df, "g", "name", "title").orderBy("ord").collect()]
    assert toc == [(1, "First", "/a"), (2, "Second", "/b"), (3, "Third", "/c")]


@pytest.mark.parametrize("seed", range(3))
def test_hot_group_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["b", "c", None]), f"{rng.randrange(60):03}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, name string, i long").repartition(7)
    got = {r.i: (r.ord, r.prev_i, r.next_i, r.prev_name) for r in N.neighbours(df, "g", ["name", "i"], ["i", "name"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        for k, r in enumerate(mine):
            before, after = (mine[k - 1] if k else None), (mine[k + 1] if k + 1 < len(mine) else None)
            want[r[2]] = (k + 1, before and before[2], after and after[2], before and before[1])
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, name string, title string")
    assert N.neighbours(df, "g", ["name"], ["title"]).count() == 0


def test_numbers_as_text_order(spark):
    df = spark.createDataFrame([("g", f"{i}.x.md", "t") for i in (1, 2, 10)], "g string, name string, title string")
    assert [r.to for r in N.contents_entries(df, "g", "name", "title").orderBy(F.col("ord")).collect()] == ["/1.x", "/10.x", "/2.x"]
