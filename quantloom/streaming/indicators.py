"""Indicators on a stream of bars, one state a symbol, equal to the batch results of the same bars.

State is typed and kept by part: a ring of as many past bars as the widest window reaches back, and each exponential mean, tail or
sum under a name of its own, so that a bar writes what the outputs asked for need and nothing else.

Without a watermark the bars of a batch are taken in time order and a bar not later than the symbol's last one is dropped. With
one, bars wait in a buffer until the watermark passes them and are then taken in time order, whatever order they came in: a timer
at the earliest waiting bar releases them. Bars behind the watermark are dropped by Spark and counted (`late_bars`). A bar that
comes twice before its release counts once, the later arrival (in one batch the greater prices). Rows without a symbol move the
watermark and are no bars (a feed's clock: they let the last bars go); rows without a date or with a null or nan price or volume
are ignored. `idle` forgets a symbol that had no bar for so long: its next bar is a first one.

The outputs of a running query cannot change under its checkpoint (that raises an error); see `reconfigure`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .values import FIELDS, FORMULAS, Running, needs

#: Outputs by name; any other name with a formula of `values` and its parameters may be asked for.
STANDARD = {
    "ma5": ("ma", 5), "ma20": ("ma", 20), "vol_ma5": ("vol_ma", 5), "macd": ("macd", 12, 26), "macd_signal": ("macd_signal", 12, 26, 9), "macd_hist": ("macd_hist", 12, 26, 9),
    "rsi14": ("rsi", 14), "expma12": ("expma", 12), "mb20": ("ma", 20), "up20": ("boll", 20, 2), "dn20": ("boll", 20, -2), "wr10": ("wr", 10), "obv": ("obv",),
    "dma": ("dma", 10, 50), "swl": ("swl",), "sws": ("sws",), "bbi": ("bbi", 3, 6, 12, 24), "k14": ("kdj_k", 14, 3), "d14": ("kdj_d", 14, 3), "j14": ("kdj_j", 14, 3),
    "pdi_14": ("pdi", 14), "ndi_14": ("ndi", 14), "adx_14": ("adx", 14), "adxr_14": ("adxr", 14), "trix12": ("trix", 12), "trma12": ("trma", 12, 9), "sar": ("sar",),
}
OUTPUTS = tuple(STANDARD)

BAR = ("open", *FIELDS)


def resolve(outputs) -> dict[str, tuple]:
    """Outputs as name -> (formula, parameters), from names of STANDARD or such a mapping."""
    calls = {name: tuple(call) for name, call in outputs.items()} if isinstance(outputs, dict) else {name: STANDARD.get(name, (name,)) for name in outputs}
    unknown = sorted(name for name, call in calls.items() if call[0] not in FORMULAS)
    if unknown:
        raise ValueError(f"unknown outputs {unknown}")
    return calls


class IndicatorProcessor(StatefulProcessor):
    def __init__(self, outputs: dict[str, tuple], reorder: bool = False, idle_ms: int | None = None):
        self.outputs, self.reorder, self.idle = outputs, reorder, idle_ms
        self.signature = json.dumps({k: list(v) for k, v in outputs.items()})
        self.keep = needs(outputs)[1]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "last bigint, bars bigint, due bigint, timer bigint, outputs string")
        self.ring = handle.getMapState("ring", "slot int", "bar bigint, high double, low double, close double, volume double")
        self.parts = handle.getMapState("parts", "part string", "numbers array<double>")
        self.waiting = handle.getListState("waiting", "at bigint, open double, high double, low double, close double, volume double")

    def _meta(self) -> dict:
        """last: microseconds of the last bar taken; bars: their number; due, timer: milliseconds of the earliest waiting bar, of the timer."""
        got = self.meta.get()
        if got is None:
            return {"last": None, "bars": 0, "due": None, "timer": None}
        if got[4] != self.signature:
            raise ValueError("this checkpoint is of other outputs; start a new query from reconfigured()")
        return dict(zip(("last", "bars", "due", "timer"), got))

    def _keep_meta(self, meta: dict) -> None:
        self.meta.update((meta["last"], meta["bars"], meta["due"], meta["timer"], self.signature))

    def _schedule(self, meta: dict) -> None:
        """One timer a symbol: at the earliest waiting bar, else where the symbol has been idle too long."""
        at = meta["due"]
        if at is None and self.idle is not None and meta["last"] is not None:
            at = -(-meta["last"] // 1000) + self.idle
        if at != meta["timer"]:
            if meta["timer"] is not None:
                self.handle.deleteTimer(meta["timer"])
            if at is not None:
                self.handle.registerTimer(at)
            meta["timer"] = at

    def _wait(self, meta: dict, bars: list[tuple]) -> None:
        """Put bars into the buffer."""
        self.waiting.appendList(bars)
        first = -(-min(b[0] for b in bars) // 1000)
        meta["due"] = first if meta["due"] is None else min(first, meta["due"])
        self._schedule(meta)

    def _forget(self) -> None:
        for state in (self.ring, self.parts, self.waiting, self.meta):
            state.clear()

    def _take(self, symbol: str, meta: dict, bars: list[tuple]) -> pd.DataFrame | None:
        """Take bars (microseconds, open, high, low, close, volume) in their order; reads and writes the symbol's state once."""
        past = sorted((tuple(v) for v in self.ring.values()), key=lambda b: b[0])
        running = Running([b[1:] for b in past], {k[0]: list(v[0]) for k, v in self.parts.iterator()})
        out, first = [], meta["bars"]
        for bar in bars:
            if meta["last"] is not None and bar[0] <= meta["last"]:
                continue
            if self.idle is not None and meta["last"] is not None and bar[0] - meta["last"] > self.idle * 1000:
                running, first, meta["bars"] = Running(), 0, 0
                self.ring.clear()
                self.parts.clear()
            values = running.step(dict(zip(BAR, bar[1:])), self.outputs, self.keep)
            meta["last"], meta["bars"] = bar[0], meta["bars"] + 1
            out.append({"symbol": symbol, "date": bar[0], "close": bar[4], **values})
        if not out:
            return None
        new = running.bars[-min(self.keep, meta["bars"] - first) :] if self.keep else []
        for i, bar in enumerate(new, meta["bars"] - len(new)):
            self.ring.updateValue((i % self.keep,), (i, *bar))
        for name, numbers in running.parts.items():
            self.parts.updateValue((name,), ([float(x) for x in numbers],))
        return pd.DataFrame(out)[["symbol", "date", "close", *self.outputs]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = []
        for chunk in rows:
            chunk = chunk.dropna(subset=["at", *BAR])
            bars += zip(chunk["at"].astype("int64").tolist(), *(chunk[c].astype(float).tolist() for c in BAR))
        if key[0] is None or not bars:
            return
        bars, meta = sorted(bars), self._meta()
        if not self.reorder:
            got = self._take(key[0], meta, list({b[0]: b for b in bars}.values()))
            if got is not None:
                yield got
        else:
            bars = [b for b in bars if meta["last"] is None or b[0] > meta["last"]]
            if bars:
                self._wait(meta, bars)
        self._keep_meta(meta)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Takes all waiting bars that the watermark has passed, or forgets an idle symbol."""
        now, meta = timerValues.getCurrentWatermarkInMs(), self._meta()
        meta["timer"] = None  # it is this one
        if meta["due"] is None:
            self._forget()
            return
        waiting = {b[0]: tuple(b) for b in self.waiting.get()}
        got = self._take(key[0], meta, [waiting[t] for t in sorted(waiting) if t <= now * 1000])
        rest = [b for t, b in waiting.items() if t > now * 1000]
        self.waiting.clear()
        meta["due"] = None
        if rest:
            self._wait(meta, rest)
        else:
            self._schedule(meta)
        self._keep_meta(meta)
        if got is not None:
            yield got

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of `reconfigure.SAVED`; a symbol's rows may come in several frames."""
        meta = self._meta()
        for kind, name, n, numbers in zip(*(initialState[c].tolist() for c in ("kind", "name", "n", "numbers"))):
            numbers = [float(x) for x in numbers]
            if kind == "meta":
                meta["last"], meta["bars"] = int(n), int(numbers[0])
            elif kind == "ring" and self.keep:
                self.ring.updateValue((int(n) % self.keep,), (int(n), *numbers))
            elif kind == "part":
                self.parts.updateValue((name,), (numbers,))
            elif kind == "waiting" and self.reorder:
                self._wait(meta, [(int(n), *numbers)])
        if self.reorder:
            self._schedule(meta)
        self._keep_meta(meta)

    def close(self) -> None:
        pass


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval) / pd.Timedelta(milliseconds=1))


def stream_indicators(bars: DataFrame, watermark: str | None = None, outputs=OUTPUTS, idle: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """A streaming frame of the outputs wanted (names of STANDARD, or name -> formula and parameters) from a streaming frame of
    bars (symbol string, date timestamp, open, high, low, close, volume). With a watermark ("2 hours"), bars are put in order.
    idle ("30 days") needs a watermark. initial: the state that reconfigured() gives. Needs the RocksDB state store provider."""
    calls = resolve(outputs)
    if idle and not watermark:
        raise ValueError("idle needs a watermark")
    if watermark:
        bars = bars.withWatermark("date", watermark)
    bars = bars.select(F.col("symbol").cast("string").alias("symbol"), "date", F.unix_micros(F.col("date").cast("timestamp")).alias("at"), *[F.col(c).cast("double").alias(c) for c in BAR])
    schema = "symbol string, date bigint, close double, " + ", ".join(f"`{c}` double" for c in calls)
    processor = IndicatorProcessor(calls, bool(watermark), _milliseconds(idle) if idle else None)
    out = bars.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if watermark else "None",
        initialState=None if initial is None else initial.groupBy("symbol"),
    )
    return out.withColumn("date", F.timestamp_micros("date"))


def late_bars(query: StreamingQuery) -> int:
    """Bars that came behind the watermark, over the progress reports that the query still holds."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
