"""Repeatable sampling and layout: quotas by hash rank, k of n, adjacent triples, slots, running clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_quota(df: DataFrame, by: list[str], order: Column, key: str, n: int) -> DataFrame:
    """The first n rows of each group by a hash, ties by key, with their rank."""
    w = Window.partitionBy(*by).orderBy(order, key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_k_by_hash(items: Column, order: Callable[[Column], Column], k: Column) -> Column:
    """The first k elements of an array in the order of a hash of each."""
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(order(x).alias("h"), x.alias("x"))))
    return F.transform(F.slice(keyed, F.lit(1), k), lambda s: s["x"])


def adjacent_triples(grid: DataFrame) -> DataFrame:
    """Positions (x, y) whose next two neighbours along x are there too."""
    step = lambda n: grid.select((F.col("x") - n).alias("x"), "y")
    return grid.select("x", "y").join(step(1), ["x", "y"]).join(step(2), ["x", "y"])


def slots(*axes: DataFrame) -> DataFrame:
    """Every combination of axes of fixed size, such as lots, wafers and devices."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(F.broadcast(axis))
    return out


def running_clock(start: Column, index: Column, delay: int, devices: int, interval: int, gap: int) -> Column:
    """Start of the index-th unit where each takes its delay, its devices and a gap."""
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), index * (delay + devices * interval + gap))
