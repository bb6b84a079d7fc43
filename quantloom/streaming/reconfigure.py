"""Other outputs, windows or spans for a running stream, with values as if it had had them from the start.

The stopped query's state is read with Spark's state reader. What the new outputs share with the old ones is taken over; parts
that the old state lacks, and past bars where a window grows wider, are made from the bars that the stream has taken so far
(`history`, e.g. the bar store that the same feed fills): these are sorted by symbol and date and folded as they pass, so that a
task holds one batch of bars and one symbol's parts. A symbol's bars pass through one task, for a recursion has an order. The
result is the initial state of a new query with a checkpoint of its own. Bars that the new query reads again are known by their
date: those not later than a symbol's last one are passed over, and waiting ones replace themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from .indicators import BAR, OUTPUTS, _milliseconds, resolve
from .values import FIELDS, Running, needs

#: kind: meta (n: last bar's microseconds, numbers: how many bars), ring (n: bar number), part (by name) or waiting (n: microseconds).
SAVED = "symbol string, kind string, name string, n bigint, numbers array<double>"


def saved_state(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """The state under a stopped query's checkpoint: its rows as SAVED, and the outputs it was made for (one row)."""

    def read(variable: str) -> DataFrame:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()

    symbol, none = F.col("key.symbol").alias("symbol"), F.lit(None).cast("string").alias("name")
    numbers = lambda c, names: F.array(*[F.col(f"{c}.{f}") for f in names]).alias("numbers")
    kind = lambda k: F.lit(k).alias("kind")
    meta = read("meta")
    rows = (
        meta.filter("value.last IS NOT NULL").select(symbol, kind("meta"), none, F.col("value.last").alias("n"), F.array(F.col("value.bars").cast("double")).alias("numbers")),
        read("ring").select(symbol, kind("ring"), none, F.col("user_map_value.bar").alias("n"), numbers("user_map_value", FIELDS)),
        read("parts").select(symbol, kind("part"), F.col("user_map_key.part").alias("name"), F.lit(None).cast("bigint").alias("n"), F.col("user_map_value.numbers").alias("numbers")),
        read("waiting").select(symbol, kind("waiting"), none, F.col("list_element.at").alias("n"), numbers("list_element", BAR)),
    )
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]), meta.select("value.outputs").limit(1)


def _folded(calls: dict[str, tuple], keep: int, idle: int | None):
    """A function of sorted batches of bars that gives each symbol's ring and parts."""

    def state(symbol: str, running: Running, n: int) -> pd.DataFrame:
        bars = running.bars[-min(keep, n) :] if keep else []
        rows = [(symbol, "ring", None, i, list(b)) for i, b in enumerate(bars, n - len(bars))]
        return pd.DataFrame(rows + [(symbol, "part", k, None, [float(x) for x in v]) for k, v in running.parts.items()], columns=["symbol", "kind", "name", "n", "numbers"]).astype({"n": "Int64"})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, running, n, last = None, None, 0, None
        for batch in batches:
            for bar in batch.itertuples(index=False):
                if bar.symbol != symbol:
                    if running is not None:
                        yield state(symbol, running, n)
                    symbol, running, n, last = bar.symbol, Running(), 0, None
                if last is not None and idle is not None and bar.at - last > idle * 1000:
                    running, n = Running(), 0
                running.step({c: getattr(bar, c) for c in BAR}, calls, keep)
                n, last = n + 1, bar.at
        if running is not None:
            yield state(symbol, running, n)

    return fold


def reconfigured(spark: SparkSession, checkpoint: str, outputs=OUTPUTS, history: DataFrame | None = None, idle: str | None = None) -> DataFrame:
    """The initial state of a query with these outputs, from the checkpoint of a stopped one. history: all bars taken so far (others
    are passed over; of equal dates the greatest prices count, bars with nulls are no bars); needed where the old state lacks
    something, otherwise not read. An empty checkpoint gives an empty state."""
    calls = resolve(outputs)
    parts, keep = needs(calls)
    old, made_for = saved_state(spark, checkpoint)
    was = made_for.first()
    had, reach = needs(resolve(json.loads(was[0]))) if was else (set(), 0)
    lacking, wider = parts - had, keep > reach
    meta = F.col("kind") == "meta"
    kept = old.filter(meta | (F.col("kind") == "waiting") | F.col("name").isin(sorted(parts & had)) | ((F.col("kind") == "ring") if not wider else F.lit(False)))
    kept = written(kept)
    if not was or not (lacking or wider):
        last = kept.filter(meta).select("symbol", F.col("numbers")[0].alias("_bars"))
        return kept.join(last, "symbol", "left").filter((F.col("kind") != "ring") | (F.col("n") >= F.col("_bars") - keep)).drop("_bars")
    if history is None:
        raise ValueError(f"the old state lacks {sorted(lacking)}" + (f" and bars beyond {reach}" if wider else "") + ": history is needed")
    last = kept.filter(meta).select("symbol", F.col("n").alias("_last"))
    bars = history.select(F.col("symbol").cast("string").alias("symbol"), F.unix_micros(F.col("date").cast("timestamp")).alias("at"), *[F.col(c).cast("double").alias(c) for c in BAR])
    for c in BAR:
        bars = bars.filter(F.col(c).isNotNull() & ~F.isnan(c))
    bars = bars.join(last, "symbol").filter("at <= _last").groupBy("symbol", "at").agg(F.max(F.struct(*BAR)).alias("b")).select("symbol", "at", "b.*")
    found = bars.repartition("symbol").sortWithinPartitions("symbol", "at").mapInPandas(_folded(calls, keep, _milliseconds(idle) if idle else None), SAVED)
    found = found.filter(F.col("name").isin(sorted(lacking)) | ((F.col("kind") == "ring") if wider else F.lit(False)))
    return written(kept.unionByName(found))
