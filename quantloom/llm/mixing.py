"""Mixing sources to target weights: repetition rates per source, floor(rate) copies plus one hash-seeded Bernoulli copy.

Native: DataFrame functions only. Sizes are summed per source with partial aggregation; the table of rates has one row per
source. It is broadcast only after a count proves it small, otherwise joined by a shuffle that adaptive execution splits.

Defined cases: null text has size 0; the null source is a source of its own, last in order; a source without words has
target 0 and rate 0; repeated rows with one doc_id share one decision; a null doc_id draws by its text "null"; an empty
table gives no rows; extra columns pass through whatever their names, but mix_plan() replaces the four that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, fresh, materialise

#: Weights dealt to the sources in their order, again and again.
WEIGHTS = (3, 1, 2)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """52 bits of an MD5 of seed and id as a number in [0, 1); the same on every run and engine."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: source_size, target, rate. Targets fill by weight up to most x size (water-filling in closed form).

    In order of cap per weight, a source is at its cap exactly if the level reached with it and all later sources still
    open exceeds its own cap per weight; all later sources share what is left by weight."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    level = Window.orderBy("_cap_per_weight", F.col("source").isNull(), "source")
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    all_rows = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = total.withColumn("_w", w.cast("double")).withColumn("_cap_per_weight", F.col("source_size") * most / F.col("_w"))
    out = out.withColumn("_left", F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
    out = out.withColumn("_level", F.col("_left") / F.sum("_w").over(rest))
    out = out.withColumn("_open_level", F.max(F.when(F.col("_cap_per_weight") > F.col("_level"), F.col("_level"))).over(all_rows))
    open_ = F.col("_cap_per_weight") > F.col("_level")
    out = out.withColumn("target", F.when(open_, F.col("_open_level") * F.col("_w")).otherwise(F.col("source_size") * most))
    return out.select("source", "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))


def _planned(docs: DataFrame, share: float, most: float, weights: tuple[int, ...], seed: str) -> tuple[DataFrame, dict[str, Column]]:
    """docs with a rate joined to each row, and the columns of the plan by name."""
    rates = source_rates(docs.select("source", size_of(F.col("text")).alias("size")), share, most, weights)
    names = fresh(docs, *[f"_{c}" for c in rates.columns])
    rates = materialise(rates.toDF(*names))
    source, total, target, rate = names
    joined = docs.join(broadcast_if_small(rates, 100_000), docs["source"].eqNullSafe(rates[source]))
    whole = F.floor(rate)
    extra = (uniform(F.col("doc_id"), seed) < F.col(rate) - whole).cast("long")
    return joined, {"size": size_of(F.col("text")), "source_size": F.col(total), "target": F.col(target), "copies": whole + extra}


def mix_plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix-1:") -> DataFrame:
    """docs plus size, source_size, target and copies (how often the mix takes the document); like-named columns go."""
    plan, added = _planned(docs, share, most, weights, seed)
    return plan.select(*[docs[c] for c in docs.columns if c not in added], *[c.alias(name) for name, c in added.items()])


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix-1:") -> DataFrame:
    """The mixed corpus: each row as often as the plan takes it, with the columns of docs."""
    plan, added = _planned(docs, share, most, weights, seed)
    (copy,) = fresh(docs, "_copy")
    return plan.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), added["copies"].cast("int"))).alias(copy)).drop(copy)
