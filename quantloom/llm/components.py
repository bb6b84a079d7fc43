"""Connected components of a distributed list of links by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _priority(name: str) -> Column:
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("v"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b: long) that has another end; component is one of its nodes.

    Each round every node joins the neighbour of least hash (a random priority, so chains halve too) and the links are
    drawn anew between what is left. Minima are partially aggregated, so the centre of a large star is no hot key; the
    joins are plain equi-joins that adaptive execution splits. Links (x, x) and repeated links change nothing."""
    links = materialise(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct())
    mapping = None
    while links.take(1):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = both.groupBy("a").agg(F.min(_priority("b")).alias("m")).select(F.col("a").alias("n"), F.least("m", _priority("a"))["v"].alias("root"))
        label = materialise(label)
        if mapping is None:
            mapping = label.select(F.col("n").alias("node"), F.col("root").alias("component"))
        else:
            mapping = materialise(mapping.join(label, mapping["component"] == label["n"], "left").select("node", F.coalesce("root", "component").alias("component")))
        a, b = label.select(F.col("n").alias("a"), F.col("root").alias("ra")), label.select(F.col("n").alias("b"), F.col("root").alias("rb"))
        links = materialise(links.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return mapping if mapping is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
