import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import alpha, order_stats
from quantloom.operators.factor_analysis import validity


@pytest.fixture(scope="module")
def tied(spark):
    """90 % of the values of f are 0, as a factor's are until its window is full; g is free of ties, h constant."""
    rng = np.random.default_rng(6)
    n = 40_000
    f = np.where(rng.random(n) < 0.9, 0.0, rng.normal(size=n))
    g, y = rng.normal(size=n), rng.normal(size=n)
    y = np.where(rng.random(n) < 0.3, 0.5, y + 0.2 * f)
    y[::97] = np.nan
    rows = list(zip(f.tolist(), g.tolist(), [1.0] * n, [None if np.isnan(v) else v for v in y.tolist()]))
    return spark.createDataFrame(rows, "f double, g double, h double, target double").repartition(8), rows


def ranks(x):
    order = np.sort(x)
    return (np.searchsorted(order, x) + np.searchsorted(order, x, "right") + 1) / 2


@pytest.mark.parametrize(("at_once", "most"), [(200_000, 500_000), (0, 500_000), (0, 10)])
def test_rank_correlations(tied, at_once, most):
    df, rows = tied
    got = {r.factor: r for r in alpha.information_coefficients(df, ["f", "g", "h"], most=most, at_once=at_once, pieces=16).collect()}
    a = np.array([r for r in rows if r[3] is not None], float)
    for i, c in enumerate("fgh"):
        assert got[c].n == len(a)
        if c == "h":
            assert got[c].ic is None and got[c].rank_ic is None
            continue
        assert got[c].ic == pytest.approx(np.corrcoef(a[:, i], a[:, 3])[0, 1], abs=1e-9)
        assert got[c].rank_ic == pytest.approx(np.corrcoef(ranks(a[:, i]), ranks(a[:, 3]))[0, 1], abs=1e-9)


def test_ties_make_no_large_task(spark, tied):
    """Pieces hold distinct values: with 90 % equal values no piece is more than twice the median."""
    counts = order_stats.value_counts(tied[0].withColumn("k", F.lit(1)), ["k"], "f")
    placed = order_stats.below(counts, ["k"], "f", pieces=16, at_once=0)
    rows = sorted((r.f, r.n, r.before, r.total) for r in placed.collect())
    before = 0
    for _, n, b, total in rows:
        assert b == before and total == 40_000
        before += n
    edges = counts.agg(F.percentile_approx("f", F.array(*[F.lit(i / 16) for i in range(1, 16)]), F.lit(160))).first()[0]
    held = np.bincount(np.searchsorted(edges, [r[0] for r in rows], "right"))
    assert held.max() <= 2 * np.median(held)
    assert max(r[1] for r in rows) > 30_000


def test_few_rows_and_none(spark):
    schema = "f double, target double"
    one = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0)], schema)
    assert [(r.factor, r.ic, r.rank_ic, r.n) for r in alpha.information_coefficients(one, ["f"]).collect()] == [("f", 0.0, 0.0, 1)]
    assert alpha.information_coefficients(spark.createDataFrame([], schema), ["f"]).collect() == []
    assert alpha.quantile_test(spark.createDataFrame([], schema), "f").collect() == []
    assert [(r.factor, r.weight) for r in alpha.factor_weights(one, ["f"]).collect()] == [("f", None)]


def test_plans_are_short(tied):
    """The input is stacked once and written; what follows reads tables."""
    for df in (alpha.information_coefficients(tied[0], ["f", "g"]), alpha.quantile_test(tied[0], "f"), alpha.factor_weights(tied[0], ["f", "g"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ExistingRDD") <= 1 and plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 8


def test_validity_by_symbol_with_ties(spark):
    rows = [(s, i, float(i % 7 if s == "a" else i), float(10 + (i * 7919) % 13)) for s in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, date int, x double, close double")
    got = {r.symbol: r for r in validity(df, ["x"]).collect()}
    for s in "ab":
        mine = [r for r in rows if r[0] == s]
        x, y = np.array([r[2] for r in mine[1:]]), np.array([b[3] / a[3] - 1 for a, b in zip(mine, mine[1:])])
        at = np.searchsorted(np.percentile(x, [20, 40, 60, 80]), x, "left")
        assert got[s].n == 59 and got[s].long_return == pytest.approx(y[at == at.max()].mean()) and got[s].short_return == pytest.approx(y[at == at.min()].mean())
