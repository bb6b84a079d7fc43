"""Merged summaries against statistics of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import prep, summaries

COLUMNS = ("x", "y")


@pytest.fixture(scope="module")
def bars(spark):
    """A long symbol, one with many ties, one of a single bar, one without values, one without a name."""
    rng, rows = random.Random(7), []
    for i in range(6000):
        rows.append(("long", i % 12, rng.gauss(0, 1) ** 3, float(i)))
    for i in range(900):
        rows.append(("ties", i % 5, float(rng.choice([1, 1, 1, 2, 9])), None if i % 3 else float("nan") if i % 2 else 4.0))
        rows.append((None, i % 4, rng.random(), 1.0))
    rows += [("one", 3, 5.0, None), ("none", 2, None, float("nan"))]
    return spark.createDataFrame(rows, "symbol string, day int, x double, y double").withColumns({"n": F.lit(1), "value": F.lit("v")})


def want(bars, at):
    rows = []
    for c in COLUMNS:
        v = F.nanvl(c, F.lit(None))
        rows += bars.groupBy("symbol").agg(F.lit(c).alias("column"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), *[F.percentile(v, p) for p in at]).collect()
    return {(r["symbol"], r["column"]): tuple(r)[2:] for r in rows}


@pytest.mark.parametrize(("k", "margin"), [(200, 0.04), (8, 0.001)])
def test_equal_to_all_rows(bars, k, margin):
    """Also with sketches so coarse that most ranks are missed at first."""
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    whole = summaries.merged(summaries.summarise(bars, F.col("day"), COLUMNS, k))
    moments = {(r["symbol"], r["column"]): r for r in whole.collect()}
    got = {(r["symbol"], r["column"]): r for r in summaries.quantiles(whole, bars, at, margin).collect()}
    expected = want(bars, at)
    assert set(got) == set(moments) == set(expected)
    for key, (n, nulls, mean, sd, *q) in expected.items():
        m = moments[key]
        assert (m["n"], m["nulls"], got[key]["n"]) == (n, nulls, n)
        for a, b in ((m["mean"], mean), (m["sd"], sd)):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-9), key
        assert got[key]["q"] == (q if n else None), key


def test_a_range_and_a_changed_period(bars):
    """A range merges its periods; a period summarised again replaces its own rows alone."""
    made = summaries.summarise(bars, F.col("day"), COLUMNS)
    revised = bars.withColumn("x", F.when(F.col("day") == 3, F.col("x") * 10).otherwise(F.col("x")))
    again = summaries.refreshed(made, summaries.summarise(revised.filter("day = 3"), F.col("day"), COLUMNS))
    part = revised.filter("day BETWEEN 2 AND 7")
    got = {(r["symbol"], r["column"]): r["q"] for r in summaries.quantiles(summaries.merged(again.filter("period BETWEEN 2 AND 7")), part, [0.25, 0.75]).collect()}
    assert got == {k: (list(v[4:]) if v[0] else None) for k, v in want(part, [0.25, 0.75]).items()}
    kept = summaries.clean_iqr(part, summaries.quantiles(summaries.merged(again.filter("period BETWEEN 2 AND 7")), part, [0.25, 0.75]), "x", 1.5)
    named = part.filter("symbol IS NOT NULL")
    rows = lambda df: sorted(map(tuple, df.filter("symbol IN ('long', 'ties', 'one')").select("symbol", "day", "x").collect()))
    assert rows(kept) == rows(prep.clean_iqr(named, ("x",), 1.5)) and len(rows(kept)) > 1000
    assert kept.filter("symbol = 'none'").count() == 1


def test_no_rows(bars):
    nothing = bars.filter("false")
    whole = summaries.merged(summaries.summarise(nothing, F.col("day"), COLUMNS))
    quartiles = summaries.quantiles(whole, nothing, [0.25, 0.75])
    assert quartiles.count() == 0 and summaries.clean_iqr(nothing, quartiles, "x").count() == 0
