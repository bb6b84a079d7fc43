"""Streams: values against the batch forms, event-time order, late bars, idle symbols, what is written, other outputs in mid-stream."""

import uuid
from datetime import datetime, timedelta

import pytest

from quantloom.functions.registry import with_indicators
from quantloom.sources.bars import bars_hour
from quantloom.streaming.indicators import BAR, OUTPUTS, late_bars, resolve, stream_indicators
from quantloom.streaming.reconfigure import reconfigured, saved_state
from quantloom.streaming.values import Running, needs

SCHEMA = "symbol string, date timestamp, open double, high double, low double, close double, volume double"
START = datetime(2024, 1, 1)


def bars_of(symbol, n, start=START, step=1.0):
    """n hourly bars whose prices wander."""
    out = []
    for i in range(n):
        close = 100 + ((i * 37) % 23) * step - ((i * 11) % 7)
        out.append((symbol, start + timedelta(hours=i), close - 1, close + 2 + i % 3, close - 3, close, 10.0 + i % 5))
    return out


def folded(bars, outputs):
    """The outputs of bars in their order, by (symbol, date)."""
    calls, out = resolve(outputs), {}
    keep = needs(calls)[1]
    for symbol in {b[0] for b in bars}:
        running = Running()
        for b in sorted(b for b in bars if b[0] == symbol):
            out[symbol, b[1]] = running.step(dict(zip(BAR, b[2:])), calls, keep)
    return out


class Feed:
    """A folder of arriving bars and the query that drains it."""

    def __init__(self, spark, root):
        self.spark, self.root, self.run = spark, str(root), 0

    def send(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def drain(self, **options):
        source = self.spark.readStream.schema(SCHEMA).parquet(f"{self.root}/in")
        writer = stream_indicators(source, **options).writeStream.format("parquet").option("path", f"{self.root}/out{self.run}")
        query = writer.option("checkpointLocation", f"{self.root}/check{self.run}").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def got(self, run=None):
        rows = self.spark.read.parquet(f"{self.root}/out{self.run if run is None else run}").collect()
        assert len({(r["symbol"], r["date"]) for r in rows}) == len(rows)
        return {(r["symbol"], r["date"]): r for r in rows}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / uuid.uuid4().hex)


def check(got, want, outputs):
    assert set(got) == set(want)
    for key, row in want.items():
        for c in outputs:
            x, y = got[key][c], row[c]
            assert (x is None and y != y) or x == pytest.approx(y, abs=1e-9, rel=1e-9), (key, c)


def test_running_values_equal_the_batch(spark, sf_dir):
    """Bar by bar, each bar with a new object made of the kept bars and parts alone, against the window and recursion forms."""
    bars = bars_hour(spark, sf_dir).filter("symbol = 'click'")
    names = {"sws": "fsl", "k14": "kdj", "pdi_14": "dmi", "trix12": "trix", "sar": "sar"}
    batch = with_indicators(bars, sorted(set(names.values()))).orderBy("date").collect()
    calls = resolve(OUTPUTS)
    keep, past, parts = needs(calls)[1], [], {}
    for i, r in enumerate(batch):
        running = Running(past, parts)
        got = running.step({c: r[c] for c in BAR}, calls, keep)
        past, parts = running.bars[-keep:], running.parts
        assert set(got) == set(OUTPUTS)
        for c in ("sws", "k14", "d14", "j14", "pdi_14", "ndi_14", "adx_14", "adxr_14", "trix12", "trma12", *(("sar",) if i else ())):
            want = r[c]
            assert (want is None and got[c] != got[c]) or got[c] == pytest.approx(want, abs=1e-6), (i, c)
    with pytest.raises(ValueError):
        stream_indicators(bars, outputs=("nothing",))


def test_windows_by_brute_force():
    """Running sums and monotonic deques at several widths, with ties, over pieces of a stream."""
    bars = [b[2:] for b in bars_of("a", 700)]
    calls = {**{f"m{n}": ("ma", n) for n in (1, 3, 40)}, **{f"w{n}": ("wr", n) for n in (2, 9, 40)}}
    keep, past = needs(calls)[1], []
    running = Running()
    for i, b in enumerate(bars):
        if i % 97 == 0:
            running = Running(past[-keep:])
        got = running.step(dict(zip(BAR, b)), calls, keep)
        past.append(b[1:])
        for n in (1, 3, 40):
            closes = [x[2] for x in past[-n:]]
            assert got[f"m{n}"] == pytest.approx(sum(closes) / len(closes), rel=1e-12)
        for n in (2, 9, 40):
            high, low = max(x[0] for x in past[-n:]), min(x[1] for x in past[-n:])
            assert got[f"w{n}"] == pytest.approx((high - b[3]) * 100 / (high - low), rel=1e-12)


def test_bars_out_of_order(feed):
    """Bars up to five hours late within a watermark of six, over three batches: as if they had come in order. A bar sent twice counts
    once; rows with nulls and rows without a symbol are no bars, the latter let the last bars go."""
    bars = bars_of("a", 60) + bars_of("b", 45, step=0.5)
    arrival = sorted(bars, key=lambda b: (b[1] + timedelta(hours=(b[1].hour * 7) % 6), b[0]))
    outputs = ("ma5", "macd_signal", "rsi14", "wr10", "obv", "adx_14", "sar")
    for i in range(3):
        extra = [arrival[i], ("a", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("b", START, 1.0, 1.0, 1.0, None, 1.0)] if i == 0 else []
        feed.send(arrival[i * 35 : (i + 1) * 35] + extra)
        query = feed.drain(watermark="6 hours", outputs=outputs)
    assert late_bars(query) == 0
    assert len(feed.got()) < len(bars)  # the last ones wait
    feed.send([(None, START + timedelta(days=30), None, None, None, None, None)])
    feed.drain(watermark="6 hours", outputs=outputs)
    check(feed.got(), folded(bars, outputs), outputs)


def test_late_bars_are_counted(feed):
    bars = bars_of("a", 30)
    feed.send(bars[:10] + bars[12:])
    feed.drain(watermark="2 hours", outputs=("ma5",))
    feed.send(bars[10:12] + [(None, START + timedelta(days=30), None, None, None, None, None)])
    query = feed.drain(watermark="2 hours", outputs=("ma5",))
    assert late_bars(query) == 2
    check(feed.got(), folded(bars[:10] + bars[12:], ("ma5",)), ("ma5",))


def test_idle_symbols_are_forgotten(spark, feed):
    """A pause of four days makes the next bar a first one; a symbol that never comes back leaves no state."""
    early, late = bars_of("a", 20), bars_of("a", 20, START + timedelta(days=5))
    gone = bars_of("gone", 5)
    options = {"watermark": "1 hour", "outputs": ("ma5", "macd", "obv"), "idle": "3 days"}
    feed.send(early + gone)
    feed.drain(**options)
    feed.send(late)
    feed.drain(**options)
    feed.send([(None, START + timedelta(days=6, hours=12), None, None, None, None, None)])
    feed.drain(**options)
    want = {**folded(early, options["outputs"]), **folded(gone, options["outputs"]), **folded(late, options["outputs"])}
    check(feed.got(), want, options["outputs"])
    assert {r[0] for r in saved_state(spark, f"{feed.root}/check0")[0].select("symbol").distinct().collect()} == {"a"}


def test_state_holds_what_is_asked_for(spark, feed):
    """One output keeps its own parts; a wide window elsewhere costs it nothing."""
    feed.send(bars_of("a", 80))
    feed.drain(outputs=("rsi14",))
    rows = saved_state(spark, f"{feed.root}/check0")[0].collect()
    assert sorted((r["kind"], r["name"]) for r in rows) == [("meta", None), ("part", "ewm gain 14"), ("part", "ewm loss 14"), ("ring", None)]
    feed.run = 1
    feed.drain(outputs=OUTPUTS)
    rows = saved_state(spark, f"{feed.root}/check1")[0].collect()
    assert sum(r["kind"] == "ring" for r in rows) == 50 and len(rows) == 51 + len(needs(resolve(OUTPUTS))[0])


def test_late_in_a_stream_without_a_watermark(feed):
    bars = bars_of("a", 20)
    feed.send(bars[5:])
    feed.drain(outputs=("ma5", "obv"))
    feed.send(bars[:5])
    feed.drain(outputs=("ma5", "obv"))
    check(feed.got(), folded(bars[5:], ("ma5", "obv")), ("ma5", "obv"))


@pytest.mark.parametrize("watermark", [None, "3 hours"])
def test_other_outputs_in_mid_stream(spark, feed, watermark):
    """New indicators, other spans and a wider window from the middle on equal a stream that had them from the start. The new query
    reads the first bars again and passes over them. Dropping outputs needs no history."""
    bars = bars_of("a", 70) + bars_of("b", 50, step=0.5)
    cut = START + timedelta(hours=40)
    before, after = {"m": ("ma", 5), "e": ("macd", 12, 26)}, {"m": ("ma", 30), "e": ("macd", 12, 26), "k": ("kdj_k", 9, 3), "s": ("macd_signal", 12, 26, 9), "stop": ("sar",), "o": ("obv",)}
    feed.send([b for b in bars if b[1] < cut])
    feed.drain(watermark=watermark, outputs=before)
    old = f"{feed.root}/check0"
    with pytest.raises(ValueError, match="history"):
        reconfigured(spark, old, after)
    history = spark.createDataFrame(bars + [("b", None, 1.0, 1.0, 1.0, 1.0, 1.0), bars[0]], SCHEMA)
    initial = reconfigured(spark, old, after, history)
    seen = feed.got()
    feed.send([b for b in bars if b[1] >= cut])
    with pytest.raises(Exception, match="other outputs"):
        feed.drain(watermark=watermark, outputs=after)
    feed.run = 1
    feed.send([(None, START + timedelta(days=30), None, None, None, None, None)])
    feed.drain(watermark=watermark, outputs=after, initial=initial)
    want = {k: v for k, v in folded(bars, after).items() if k not in seen}
    check(feed.got(), want, after)
    fewer = reconfigured(spark, old, {"m": ("ma", 3)})
    assert {r["kind"] for r in fewer.collect()} >= {"meta", "ring"} and fewer.filter("kind = 'part'").count() == 0
    assert fewer.filter("kind = 'ring'").groupBy("symbol").count().agg({"count": "max"}).first()[0] == 3
