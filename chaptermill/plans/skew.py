"""Joins whose keys may be hot: rows of hot keys are split into parts of bounded size.

A key is hot if it holds more than a given share of all rows, so there are at most 1 / share
hot keys, whatever the data; only those, with their numbers of parts, go through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of all rows, and rows, that a key has to exceed to be split.
SHARE, LEAST = 0.001, 500


def hot_keys(df: DataFrame, key: str, share: float = SHARE, least: int = LEAST) -> dict[object, int]:
    """Number of parts of each hot key of df; null is no key. One job, which reads the key column alone and counts before the shuffle.

    The driver gets the number of all rows and the 1 / share largest keys, among which all hot ones are.
    """
    keys = df.select(F.col(key).alias("k")).filter("k is not null").rollup("k").agg(F.count(F.lit(1)).alias("n"), F.grouping("k").alias("all"))
    most_hot = math.ceil(1 / share) if share else 1_000_000  # without a share, `least` alone decides
    top = keys.orderBy(F.desc("all"), F.desc("n")).limit(most_hot + 1).collect()
    total = next((r["n"] for r in top if r["all"]), 0)
    most = max(least, math.ceil(share * total))
    return {r["k"]: -(-r["n"] // most) for r in top if not r["all"] and r["n"] > most}


def _parts(key: Column, hot: dict[object, int]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(1))


def split_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread: str, how: str = "inner", share: float = SHARE, least: int = LEAST, shuffled: bool = False) -> DataFrame:
    """left joined with right on their keys, rows of left's hot keys spread over parts by a hash of column `spread`.

    Rows of right are repeated once for each part of a hot key and are few for one key (a lookup
    table). With how="left", rows of left without a key are kept and spread as well. left and
    right must not share column names; the result has the columns of both. shuffled: for whole texts, which
    are never broadcast, so that what comes after the join has tasks of one size at every size of table.
    """
    right = right.hint("merge") if shuffled else right
    hot = hot_keys(left, left_key, share, least)
    salt = F.lit(0)
    if hot:
        salt = F.pmod(F.xxhash64(spread), _parts(F.col(left_key), hot)).cast("int")
        right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), _parts(F.col(right_key), hot) - 1)))
    elif how == "left":
        right = right.withColumn("__part", F.lit(0))
    if how == "left":  # a null key matches nothing; its part may be any number
        salt = F.when(F.col(left_key).isNull(), F.hash(spread)).otherwise(salt)
    if not hot and how != "left":
        return left.join(right, F.col(left_key) == F.col(right_key), how)
    both = (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__part"))
    return left.withColumn("__salt", salt).join(right, both, how).drop("__salt", "__part")
