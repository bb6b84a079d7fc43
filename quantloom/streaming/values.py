"""Running values of one symbol, bar by bar: what an indicator needs to go on, kept apart by part.

An output is a formula of this module with its windows and spans, e.g. ("ma", 5) or ("macd_signal", 12, 26, 9). Formulas ask for
exponential means, tails of values that are averaged again and windows of the last bars; what two of them ask for alike is kept
once. Means over a window are running sums, summed anew from time to time, extremes are monotonic deques: a bar costs the same at
any width. Windows hold fewer bars at a symbol's start; nan stands for no value.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

#: What a window keeps of a bar, in this order.
FIELDS = {"high": 0, "low": 1, "close": 2, "volume": 3}


class _Mean:
    def __init__(self, n: int, values: Iterable[float]):
        self.n, self.values, self.age = n, deque(values, n), 0
        self.sum = math.fsum(self.values)

    def push(self, x: float) -> None:
        self.sum += x - (self.values[0] if len(self.values) == self.n else 0.0)
        self.values.append(x)
        self.age += 1
        if self.age >= max(self.n, 256):  # rounding errors do not add up
            self.sum, self.age = math.fsum(self.values), 0

    def get(self) -> float:
        return self.sum / len(self.values)


class _Extreme:
    """The greatest of the last n values; sign -1 gives the least."""

    def __init__(self, n: int, sign: int, values: Iterable[float]):
        self.n, self.sign, self.i, self.best = n, sign, 0, deque()
        for x in values:
            self.push(x)

    def push(self, x: float) -> None:
        x *= self.sign
        while self.best and self.best[-1][1] <= x:
            self.best.pop()
        self.best.append((self.i, x))
        if self.best[0][0] <= self.i - self.n:
            self.best.popleft()
        self.i += 1

    def get(self) -> float:
        return self.best[0][1] * self.sign


class Running:
    """The state of one symbol between bars. bars: the last ones before the next, oldest first; parts: lists of numbers by name."""

    def __init__(self, bars: Iterable[tuple] = (), parts: dict[str, list[float]] | None = None):
        self.bars, self.parts = list(bars), dict(parts or {})
        self.reach, self._windows, self._memo, self.bar = 0, {}, {}, None

    def step(self, bar: dict, outputs: dict[str, tuple], keep: int) -> dict[str, float]:
        """The outputs after one more bar; keep: how many bars stay for the next ones."""
        self.bar, self._memo = bar, {}
        got = {name: FORMULAS[call[0]](self, *call[1:]) for name, call in outputs.items()}
        self.bars.append(tuple(bar[f] for f in FIELDS))
        if len(self.bars) > 2 * keep + 64:  # cut in large steps, so that a bar costs little
            del self.bars[: len(self.bars) - keep]
        return got

    def back(self, n: int) -> list[tuple]:
        """Up to n bars before this one, oldest first."""
        self.reach = max(self.reach, n)
        return self.bars[-n:]

    def _once(self, key: tuple, make) -> object:
        """A value that several formulas share is made once a bar."""
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    def _window(self, key: tuple, n: int, field: str, new) -> object:
        def make():
            if key not in self._windows:
                at = FIELDS[field]
                self._windows[key] = new([b[at] for b in self.back(n)])
            self._windows[key].push(self.bar[field])
            return self._windows[key]

        return self._once(key, make)

    def mean(self, field: str, n: int) -> float:
        return self._window(("mean", field, n), n, field, lambda x: _Mean(n, x)).get()

    def window(self, field: str, n: int) -> Iterable[float]:
        return self._window(("mean", field, n), n, field, lambda x: _Mean(n, x)).values

    def extreme(self, field: str, n: int, sign: int) -> float:
        return self._window(("extreme", field, n, sign), n, field, lambda x: _Extreme(n, sign, x)).get()

    def ewm(self, series: str, x: float, span: int) -> float:
        """The mean of a series with weights that fall by 1-2/(span+1) a bar: a weighted sum and its weight."""

        def make():
            part = f"ewm {series} {span}"
            num, den = self.parts.get(part, (0.0, 0.0))
            r = 1 - 2 / (span + 1)
            self.parts[part] = [num * r + x, den * r + 1]
            return self.parts[part][0] / self.parts[part][1]

        return self._once(("ewm", series, span), make)

    def tail(self, series: str, x: float, n: int) -> list[float]:
        """The last n values of a series, the new one included."""

        def make():
            part = f"tail {series} {n}"
            self.parts[part] = [*self.parts.get(part, ()), x][-n:]
            return self.parts[part]

        return self._once(("tail", series, n), make)

    def change(self) -> float:
        """This close less the one before; 0 at the first bar."""
        before = self.back(1)
        return self.bar["close"] - before[0][2] if before else 0.0


def _known_mean(x: list[float]) -> float:
    there = [v for v in x if not math.isnan(v)]
    return sum(there) / len(there) if there else math.nan


def _macd(r: Running, short: int, long: int) -> float:
    return r.ewm("close", r.bar["close"], short) - r.ewm("close", r.bar["close"], long)


def _signal(r: Running, short: int, long: int, mid: int) -> float:
    return r.ewm(f"macd {short} {long}", _macd(r, short, long), mid)


def _rsi(r: Running, n: int) -> float:
    change = r.change()
    gain, loss = r.ewm("gain", max(change, 0.0), n), r.ewm("loss", max(-change, 0.0), n)
    return 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)


def _boll(r: Running, n: int, k: float) -> float:
    values, mean = r.window("close", n), r.mean("close", n)
    return mean + k * (math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) if len(values) > 1 else math.nan)


def _wr(r: Running, n: int) -> float:
    high, low = r.extreme("high", n, 1), r.extreme("low", n, -1)
    return (high - r.bar["close"]) * 100 / (high - low) if high != low else math.nan


def _obv(r: Running) -> float:
    def make():
        change = r.change()
        signed = math.copysign(r.bar["volume"], change) if change else 0.0
        r.parts["obv"] = [r.parts.get("obv", [0.0])[0] + signed]
        return r.parts["obv"][0]

    return r._once(("obv",), make)


def _bbi(r: Running, *widths: int) -> float:
    return sum(r.mean("close", n) for n in widths) / len(widths)


def _k(r: Running, n: int, m: int) -> float:
    high, low = r.extreme("high", n, 1), r.extreme("low", n, -1)
    raw = (r.bar["close"] - low) * 100 / (high - low) if high != low else math.nan
    return _known_mean(r.tail(f"raw {n}", raw, m))


def _d(r: Running, n: int, m: int) -> float:
    return _known_mean(r.tail(f"k {n}", _k(r, n, m), m))


def _directed(r: Running, n: int) -> tuple[float, float]:
    """Both directional indicators."""

    def make():
        tops, bottoms, plus, minus = [r.bar["high"]], [r.bar["low"]], 0.0, 0.0
        for high, low, close, _ in r.back(1):
            tops.append(close)
            bottoms.append(close)
            up, down = r.bar["high"] - high, low - r.bar["low"]
            plus, minus = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
        span, p, m = (sum(r.tail(s, v, n)) for s, v in (("range", max(tops) - min(bottoms)), ("plus", plus), ("minus", minus)))
        return (p * 100 / span, m * 100 / span) if span else (math.nan, math.nan)

    return r._once(("directed", n), make)


def _adx(r: Running, n: int) -> list[float]:
    """The last n+1 means of the directional difference."""
    p, m = _directed(r, n)
    dx = math.nan if math.isnan(p) else 0.0 if p + m == 0 else abs(p - m) * 100 / (p + m)
    return r.tail(f"adx {n}", _known_mean(r.tail(f"dx {n}", dx, n)), n + 1)


def _adxr(r: Running, n: int) -> float:
    adx = _adx(r, n)
    return (adx[-1] + adx[0]) / 2 if len(adx) == n + 1 else math.nan


def _trix(r: Running, n: int) -> float:
    once = r.ewm("close", r.bar["close"], n)
    thrice = r.ewm(f"thrice {n}", r.ewm(f"twice {n}", once, n), n)
    two = r.tail(f"thrice {n}", thrice, 2)
    return (two[1] - two[0]) / two[0] * 100 if len(two) > 1 and two[0] else math.nan


def _trma(r: Running, n: int, m: int) -> float:
    trix = _trix(r, n)
    return math.nan if math.isnan(trix) else r.ewm(f"trix {n}", trix, m)


def _stop(r: Running, step: float = 0.02, most: float = 0.2) -> float:
    """The parabolic stop; its side comes from the second bar, prices of a fall are mirrored."""

    def make():
        before, part = r.back(2), f"stop {step} {most}"
        if not before:
            return math.nan
        highs, lows = [b[0] for b in before], [b[1] for b in before]
        if part not in r.parts:
            rise = r.bar["close"] > before[-1][2]
            r.parts[part] = [1.0, lows[-1], highs[-1], step] if rise else [-1.0, -highs[-1], -lows[-1], step]
        side, stop, extreme, pace = r.parts[part]
        sides = lambda s: (lows, r.bar["low"], r.bar["high"]) if s > 0 else ([-h for h in highs], -r.bar["high"], -r.bar["low"])
        past, near, far = sides(side)
        stop = max(stop + pace * (extreme - stop), *past)
        if near < stop:
            side, stop = -side, -extreme
            extreme, pace = sides(side)[2], step
        elif far > extreme:
            extreme, pace = far, min(pace + step, most)
        r.parts[part] = [side, stop, extreme, pace]
        return side * stop

    return r._once(("stop", step, most), make)


FORMULAS = {
    "ma": lambda r, n: r.mean("close", n), "vol_ma": lambda r, n: r.mean("volume", n), "expma": lambda r, n: r.ewm("close", r.bar["close"], n),
    "macd": _macd, "macd_signal": _signal, "macd_hist": lambda r, *a: _macd(r, *a[:2]) - _signal(r, *a), "rsi": _rsi, "boll": _boll, "wr": _wr, "obv": _obv,
    "dma": lambda r, short, long: r.mean("close", short) - r.mean("close", long), "bbi": _bbi,
    "swl": lambda r: (r.bar["high"] + r.bar["low"] + r.bar["close"]) / 3, "sws": lambda r: (r.bar["high"] + r.bar["low"] + r.bar["close"] + r.bar["open"]) / 4,
    "kdj_k": _k, "kdj_d": _d, "kdj_j": lambda r, n, m: 3 * _k(r, n, m) - 2 * _d(r, n, m),
    "pdi": lambda r, n: _directed(r, n)[0], "ndi": lambda r, n: _directed(r, n)[1], "adx": lambda r, n: _adx(r, n)[-1], "adxr": _adxr,
    "trix": _trix, "trma": _trma, "sar": _stop,
}


def needs(outputs: dict[str, tuple]) -> tuple[set[str], int]:
    """The parts and the number of past bars that outputs keep, found by taking a few bars."""
    probe = Running()
    for i in range(4):
        probe.step({"open": 10.0 + i, "high": 12.0 + i, "low": 9.0 + i, "close": 11.0 + i, "volume": 1.0}, outputs, 8)
    return set(probe.parts), probe.reach
