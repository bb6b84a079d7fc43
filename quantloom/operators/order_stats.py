"""Exact ranks and percentiles of groups of any size, from counts of their distinct values.

A group's values are counted first, so ties cost one row however many they are. The distinct values are cut into pieces of their
range (edges from approximate percentiles, so that pieces are about even); a piece's rows are summed, the sums of the pieces
below are its base, and running sums within the pieces do the rest. No task sorts more than a piece of a
large group's distinct values.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A value with more than this share of its group's rows is joined by broadcast: there are at most so many of them a group.
HOT = 10_000


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: the rows of each distinct value; partially aggregated before the shuffle."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], hint=lambda df: df) -> DataFrame:
    """left with the other columns of right, joined on keys of which null is one."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    joined = left.join(hint(renamed), reduce(and_, [left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys]))
    return joined.drop(*[f"_key_{k}" for k in keys])


def below(counts: DataFrame, keys: list[str], value: str, pieces: int = 64, few: bool = True, at_once: int = 200_000) -> DataFrame:
    """counts (keys, value, n) plus before, the rows of lower values, and total, all rows of the group. Up to `at_once` counts
    are sorted as they are; more of them in pieces. few: the groups are few enough to broadcast `pieces` rows for each. counts
    is read up to three times: write it first."""
    if pieces <= 1 or at_once and counts.limit(at_once + 1).count() <= at_once:
        group = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumns({"before": before, "total": F.sum("n").over(group)})
    hint = F.broadcast if few else lambda df: df
    at = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, at, F.lit(10 * pieces)).alias("_e"))
    # a value's piece is looked up in two steps of about the root of `pieces` comparisons: every step-th edge, then those after it
    step = max(1, round(pieces**0.5))
    edges = edges.withColumn("_c", F.filter("_e", lambda e, i: (i + 1) % step == 0))
    reached = lambda of: F.when(of.isNull(), 0).otherwise(F.size(F.filter(of, lambda e: e <= F.col(value))))
    placed = same_keys(counts, edges, keys, hint).withColumn("_b", reached(F.col("_c")) * step)
    placed = placed.withColumn("_b", F.col("_b") + reached(F.slice("_e", F.col("_b") + 1, step))).drop("_e", "_c")
    group = Window.partitionBy(*keys)
    lower = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("total"))
    within = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return same_keys(placed, sums, [*keys, "_b"], hint).withColumn("before", before).drop("_b", "_base")


def mean_rank() -> Column:
    """Of a row of below(): the rank from 1, ties by their mean rank."""
    return F.col("before") + (F.col("n") + 1) / 2


def percentiles(placed: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """keys, n and e, the linear percentiles, for each group of below(): its order statistics are read off the counts."""

    def statistic(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))

    spot = lambda p: (F.col("total") - 1) * p
    found = [f(i, p) for i, p in enumerate(at) for f in (lambda i, p: statistic(F.floor(spot(p))).alias(f"_l{i}"), lambda i, p: statistic(F.ceil(spot(p))).alias(f"_h{i}"))]
    one = placed.groupBy(*keys).agg(F.max("total").alias("total"), *found)
    linear = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (spot(p) - F.floor(spot(p))) for i, p in enumerate(at)]
    return one.select(*keys, F.col("total").alias("n"), F.array(*linear).alias("e"))


def joined(df: DataFrame, placed: DataFrame, on: list[str], most: int = 500_000) -> DataFrame:
    """df with the columns of a written table made from below(), joined on group and value. A table of at most `most` rows is
    broadcast. Of a larger one the hot values are, at most HOT a group, and the others are shuffled, none of them hot."""
    if placed.count() <= most:
        return df.join(F.broadcast(placed), on)
    hot = placed.filter(F.col("n") * HOT > F.col("total"))
    cold = placed.filter(F.col("n") * HOT <= F.col("total"))
    rest = df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.hint("shuffle_hash"), on)
    return df.join(F.broadcast(hot), on).unionByName(rest)
