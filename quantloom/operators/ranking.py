"""Ranking of symbols by score: one window and one aggregation over the panel, then a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..windows import KEY, TIME, lag, ratio

WEIGHTS = {"momentum": 0.2, "volatility": 0.2, "value": 0.2, "quality": 0.2, "growth": 0.2}


def _features(bars: DataFrame, least: int = 20, period: int = 20) -> DataFrame:
    """Per symbol with at least `least` bars: what the scores need. The k-th bar from the end is number k; pn is the close
    `period` bars from the end, or the first one there is."""
    df = bars.withColumns({"_k": F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME))), "_r": ratio(F.col("close") - lag("close"), lag("close"))})
    at = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    recent = F.when(F.col("_k") <= period, F.col("close"))
    made = {f"p{k}": at("close", k) for k in (1, 10, 20, 60)} | {f"v{k}": at("volume", k) for k in (1, 10)}
    made["pn"] = F.coalesce(at("close", period), F.max_by("close", "_k"))
    made |= {"bars": F.count("*"), "cv": F.try_divide(F.stddev_pop(recent), F.avg(recent)), "mean_r": F.avg("_r"), "std_r": F.stddev_pop("_r")}
    made |= {"v_new": F.avg(F.when(F.col("_k") <= 5, F.col("volume"))), "v_old": F.avg(F.when(F.col("_k").between(6, 10), F.col("volume")))}
    return df.groupBy(KEY).agg(*[c.alias(n) for n, c in made.items()]).filter(F.col("bars") >= least)


def _move(k: int) -> Column:
    return F.coalesce(ratio(F.col("p1") - F.col(f"p{k}"), f"p{k}"), F.lit(0.0))


def score(bars: DataFrame, method: str = "multi_factor", weights: dict[str, float] | None = None, period: int = 20) -> DataFrame:
    """symbol, score (0 to 1), risk_score, adjusted_score, signal, risk_level. method: multi_factor, momentum (over `period`
    bars) or industry."""
    g = WEIGHTS | (weights or {})
    raw = {
        "multi_factor": (_move(10) + _move(20)) * g["momentum"] + (1 - F.col("cv")) * g["volatility"] + F.coalesce(ratio(F.col("v1") - F.col("v10"), "v10"), F.lit(0.0)) * g["value"] + F.col("mean_r") / (F.col("std_r") + 1e-10) * g["quality"] + F.col("mean_r") * g["growth"],
        "momentum": F.coalesce(ratio(F.col("p1") - F.col("pn"), "pn"), F.lit(0.0)) * 2,
        "industry": _move(20) * 0.4 + _move(60) * 0.3 + (F.col("v_new") - F.col("v_old")) / (F.col("v_old") + 1e-10) * 0.3 + 0.5,
    }[method]
    df = _features(bars, period=period if method == "momentum" else 20).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    df = df.withColumn("risk_score", F.least(F.lit(100.0), F.col("cv") * 200)).withColumn("adjusted_score", F.col("score") * (1 - F.col("risk_score") / 100))
    signal = F.when(F.col("adjusted_score") > 0.7, "buy").when(F.col("adjusted_score") > 0.3, "hold").otherwise("sell")
    level = F.when(F.col("risk_score") < 30, "low").when(F.col("risk_score") < 60, "medium").otherwise("high")
    return df.select(KEY, "score", "risk_score", "adjusted_score", signal.alias("signal"), level.alias("risk_level"))


def top(scores: DataFrame, n: int = 10) -> DataFrame:
    """The n best by adjusted score, ties by symbol (the feature's own limit)."""
    return scores.orderBy(F.desc("adjusted_score"), KEY).limit(n)


def report(scores: DataFrame, universe: DataFrame) -> DataFrame:
    """Per industry: symbols, signals of each kind, mean scores."""
    df = scores.join(universe.select(KEY, "industry"), KEY)
    return df.groupBy("industry").agg(F.count("*").alias("n"), *[F.count_if(F.col("signal") == s).alias(f"n_{s}") for s in ("buy", "hold", "sell")], F.avg("score").alias("mean_score"), F.avg("risk_score").alias("mean_risk"), F.avg("adjusted_score").alias("mean_adjusted"))
