"""Neighbours and places in an order, for groups of any size.

A window over a group sorts the whole group in one task. Here the rows are ordered over all
tasks by range, so a group that holds a third of all rows is spread like any other; each
task passes its rows once, and only what stands at the borders of tasks (two rows and one
count for each task) goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..plans.lineage import kept


def neighbours(df: DataFrame, group: str, order: list[str], values: list[str]) -> DataFrame:
    """df with ord (from 1 in its group) and prev_X and next_X of each X in values, null at the ends of a group.

    order has to tell rows of a group apart; repeated rows are neighbours of each other. A null
    group is a group of its own. Columns already named like the new ones are replaced. The result is computed from a checkpoint of df's columns.
    """
    spark = df.sparkSession
    df = df.drop("ord", *(f"{side}_{v}" for v in values for side in ("prev", "next")))
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = kept(df.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order))
    schema = ordered.schema

    def edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        same = 0
        for part in parts:
            if len(part):
                first = part.iloc[[0]] if first is None else first
                key = part[group].iloc[-1]
                here = part[group].isna() if pd.isna(key) else part[group] == key
                again = last is not None and _same(last[group].iloc[0], key)
                same = int(here.sum()) + (same if again and here.all() else 0)
                last = part.iloc[[-1]]
        if first is not None:
            pid = TaskContext.get().partitionId()
            yield pd.concat([first.assign(__pid=pid, __tail=0), last.assign(__pid=pid, __tail=same)])

    names = [group, *values]
    borders = ordered.select(*names).mapInPandas(edges, StructType([*(schema[n] for n in names), StructField("__pid", LongType()), StructField("__tail", LongType())])).toPandas()
    # Two rows for each task: bounded by the number of tasks.
    pids = sorted(set(borders["__pid"].tolist()))
    heads = {p: borders[borders["__pid"] == p].iloc[0] for p in pids}
    tails = {p: borders[borders["__pid"] == p].iloc[1] for p in pids}
    before: dict[int, tuple[object, int]] = {}
    for k, p in enumerate(pids[1:], 1):
        q = pids[k - 1]
        carried = int(tails[q]["__tail"])
        if q in before and _same(before[q][0], tails[q][group]) and _same(heads[q][group], tails[q][group]):
            carried += before[q][1]
        before[p] = (tails[q][group], carried)
    after = {p: pids[k + 1] for k, p in enumerate(pids[:-1])}
    out = StructType([*schema.fields, StructField("ord", LongType()), *(StructField(f"prev_{v}", schema[v].dataType) for v in values), *(StructField(f"next_{v}", schema[v].dataType) for v in values)])
    head_values = {p: {n: heads[p][n] for n in names} for p in pids}
    tail_values = {p: {n: tails[p][n] for n in names} for p in pids}
    previous = {p: pids[k - 1] for k, p in enumerate(pids) if k}

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        last = tail_values.get(previous.get(pid))
        count = before[pid][1] if pid in before else 0
        waiting: pd.DataFrame | None = None

        def done(part: pd.DataFrame, following: dict | None) -> pd.DataFrame:
            nonlocal last, count
            key = part[group]
            shifted = key.shift(1)
            if last is not None:
                shifted.iloc[0] = last[group]
            same = (key == shifted) | (key.isna() & shifted.isna())
            if last is None:
                same.iloc[0] = False
            run = (~same).cumsum()
            ord_ = part.groupby(run.values).cumcount().to_numpy() + 1
            ord_[run.to_numpy() == 0] += count
            result = part.copy()
            result["ord"] = ord_
            for v in values:
                prev, nxt = part[v].shift(1), part[v].shift(-1)
                if last is not None:
                    prev.iloc[0] = last[v]
                prev[~same.to_numpy()] = None
                onward = key.shift(-1)
                if following is not None:
                    onward.iloc[-1], nxt.iloc[-1] = following[group], following[v]
                goes = (key == onward) | (key.isna() & onward.isna())
                if following is None:
                    goes.iloc[-1] = False
                nxt[~goes.to_numpy()] = None
                result[f"prev_{v}"], result[f"next_{v}"] = prev, nxt
            last, count = {n: part[n].iloc[-1] for n in names}, int(ord_[-1])
            return result

        for part in parts:
            if len(part):
                if waiting is not None:
                    yield done(waiting, {n: part[n].iloc[0] for n in names})
                waiting = part.reset_index(drop=True)
        if waiting is not None:
            yield done(waiting, head_values.get(after.get(pid)))

    return ordered.mapInPandas(place, out)


def _same(a: object, b: object) -> bool:
    return bool(pd.isna(a) and pd.isna(b)) or bool(a == b)


def link_target(name: Column) -> Column:
    """Link to a file: its name without extension after a slash."""
    return F.concat(F.lit("/"), T.stem(name))


def contents_entries(df: DataFrame, group: str, name: str, title: str) -> DataFrame:
    """(group, ord, title, to) of the files of each group in the order of their names; a null title is empty.

    Rows, not one array for each group: a group may hold a large part of all files.
    """
    placed = neighbours(df.select(group, name, title), group, [name, title], [name])
    return placed.select(group, "ord", F.coalesce(title, F.lit("")).alias("title"), link_target(F.col(name)).alias("to"))
