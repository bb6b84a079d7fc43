"""Statistics of any range of periods from summaries kept by symbol and period: counts, moments and quantile sketches that merge.

A new or changed period costs its own rows only. Counts, means and deviations of a range come from the summaries alone. Quantiles
are exact all the same: the merged sketch names an interval of values that holds the wanted rank almost surely, one pass over that
column counts the rows below it and each value within it, and where a rank lies outside after all the whole column is counted. Values
are counted before they are shuffled, so a symbol with most of the rows is no large group.

Null and nan are no values; they are counted as `nulls`. A group without values has null statistics and keeps all rows in
`clean_iqr`. Null symbols and periods are groups of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from ..windows import KEY
from .order_stats import below, same_keys

GROUP = [KEY, "column"]


def _values(bars: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """symbol, column, value; nan as null."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")) for c in columns])
    return bars.select(KEY, *more, F.explode(each).alias("v")).select(KEY, *[c for c in ("period",) if more], "v.column", "v.value")


def summarise(bars: DataFrame, period: Column, columns: Sequence[str], k: int = 200) -> DataFrame:
    """symbol, period, column, n, nulls, mean, m2 (sum of squared deviations), sketch. k: the sketch's size, about 1.3 % of rank at 200."""
    value = F.col("value")
    return _values(bars, columns, period.alias("period")).groupBy(KEY, "period", "column").agg(
        F.count(value).alias("n"), F.count_if(value.isNull()).alias("nulls"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"), F.kll_sketch_agg_double(value, k).alias("sketch"),
    )


def refreshed(summaries: DataFrame, changed: DataFrame) -> DataFrame:
    """Summaries with those of `changed` in place of equal symbol, period and column; the others are neither read again nor made anew."""
    keys = [KEY, "period", "column"]
    again = changed.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    kept = summaries.join(again, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left_anti")
    return kept.unionByName(changed.select(*summaries.columns))


def merged(summaries: DataFrame) -> DataFrame:
    """symbol, column, n, nulls, mean, sd (of a sample), sketch over all periods given. A group collects two numbers a period."""
    there = F.col("n") > 0
    parts = F.collect_list(F.when(there, F.struct("n", "mean")))
    one = summaries.groupBy(*GROUP).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.sum("m2").alias("_m2"),
        parts.alias("_parts"), F.kll_merge_agg_double(F.when(there, F.col("sketch"))).alias("sketch"),
    )
    between = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    sd = F.when(F.col("n") > 1, F.sqrt((F.col("_m2") + between) / (F.col("n") - 1)))
    return one.select(*GROUP, "n", "nulls", "mean", sd.alias("sd"), "sketch")


def _ranked(values: DataFrame, spots: DataFrame) -> DataFrame:
    """spots (symbol, column, i, lo, hi, place) with the exact value at each place, null where it lies outside lo to hi."""
    value = F.when(F.col("value") < F.col("lo"), float("-inf")).otherwise(F.col("value"))
    near = same_keys(values, spots, GROUP).filter("value <= hi").select(*GROUP, "i", value.alias("value"))
    counts = written(near.groupBy(*GROUP, "i", "value").agg(F.count("*").alias("n")))
    placed = below(counts, [*GROUP, "i"], "value", few=False)
    at = same_keys(placed, spots.select(*GROUP, "i", "lo", "place"), [*GROUP, "i"])

    def statistic(place: Column) -> Column:
        return F.max(F.when((F.col("value") >= F.col("lo")) & (F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))

    found = at.groupBy(*GROUP, "i").agg(statistic(F.floor("place")).alias("low"), statistic(F.ceil("place")).alias("high"))
    return spots.join(found.withColumnsRenamed({KEY: "_s", "column": "_c", "i": "_i"}), F.col(KEY).eqNullSafe(F.col("_s")) & (F.col("column") == F.col("_c")) & (F.col("i") == F.col("_i")), "left").drop("_s", "_c", "_i")


def quantiles(whole: DataFrame, bars: DataFrame, at: Sequence[float], margin: float = 0.04) -> DataFrame:
    """symbol, column, n and q, the exact linear quantiles, for the groups of merged(); bars: the rows of the same periods. margin: how
    much rank the interval spans on either side; a smaller one counts less and misses more often, which costs a second pass."""
    whole = written(whole)
    columns = [r[0] for r in whole.select("column").distinct().collect()]  # as many as columns were summarised
    if not columns:
        return whole.select(*GROUP, "n", F.array().cast("array<double>").alias("q"))

    def edge(p: float) -> Column:
        """The value at a rank by the sketch, which takes literals only; infinite beyond the ends."""
        return F.lit(float("-inf") if p <= 0 else float("inf")) if not 0 < p < 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(p))

    each = [F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * float(p)).alias("place"), edge(p - margin).alias("lo"), edge(p + margin).alias("hi")) for i, p in enumerate(at)]
    spots = whole.filter("n > 0").select(*GROUP, F.explode(F.array(*each)).alias("e")).select(*GROUP, "e.*")
    values = _values(bars, columns).filter("value IS NOT NULL")
    first = written(_ranked(values, spots))
    missed = first.filter("low IS NULL OR high IS NULL")
    found = first.filter("low IS NOT NULL AND high IS NOT NULL")
    if not missed.isEmpty():
        every = missed.select(*GROUP, "i", "place", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
        found = found.unionByName(_ranked(values, written(every)))
    place = F.col("place")
    exact = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil(place) - place) * F.col("low") + (place - F.floor(place)) * F.col("high"))
    lists = found.groupBy(*GROUP).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", exact.alias("e")))), lambda x: x["e"]).alias("q"))
    lists = lists.withColumnsRenamed({KEY: "_s", "column": "_c"})
    return whole.select(*GROUP, "n").join(lists, F.col(KEY).eqNullSafe(F.col("_s")) & (F.col("column") == F.col("_c")), "left").drop("_s", "_c")


def clean_iqr(bars: DataFrame, quartiles: DataFrame, column: str, t: float = 3.0) -> DataFrame:
    """Rows whose column lies within t quartile distances of the quartiles, from quantiles(..., [0.25, 0.75])."""
    q1, q3 = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    bounds = quartiles.filter(F.col("column") == column).select(KEY, F.col("q").alias("_q"))
    return same_keys(bars, bounds, [KEY]).filter(F.col("_q").isNull() | F.col(column).between(q1 - t * (q3 - q1), q3 + t * (q3 - q1))).drop("_q")
