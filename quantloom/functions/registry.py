"""Indicators by name, with their needs; custom ones can be added. Asked for together they share one shuffle and sort."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

from ..operators import recursive
from . import breadth, cost, oscillator, trend, volatility, volume


@dataclass(frozen=True)
class Indicator:
    name: str
    run: Callable[..., DataFrame]
    category: str
    needs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


_registry: dict[str, Indicator] = {}


def register_indicator(name: str, run: Callable[..., DataFrame], category: str = "custom", needs: Iterable[str] = (), **params) -> Indicator:
    """Add or replace an indicator: run(df, **params) -> df."""
    _registry[name] = Indicator(name, run, category, tuple(needs), params)
    return _registry[name]


def indicator(name: str, category: str = "custom", needs: Iterable[str] = (), **params):
    """Decorator form of register_indicator."""
    return lambda run: (register_indicator(name, run, category, needs, **params), run)[1]


def indicators(category: str | None = None) -> list[str]:
    return [n for n, i in _registry.items() if category in (None, i.category)]


def indicator_of(name: str) -> Indicator:
    if name not in _registry:
        raise KeyError(f"no indicator {name!r}; there are {', '.join(sorted(_registry))}")
    return _registry[name]


def with_indicators(df: DataFrame, names: Iterable[str] | None = None, **params: dict) -> DataFrame:
    """Add the named indicators (default: all) after what they need. params: keyword arguments by indicator name."""
    wanted, graph = list(names if names is not None else indicators()), {}
    while wanted:
        name = wanted.pop()
        if name not in graph:
            graph[name] = indicator_of(name).needs
            wanted += graph[name]
    for name in TopologicalSorter(graph).static_order():
        one = _registry[name]
        df = one.run(df, **{**one.params, **params.get(name, {})})
    return df


for _category, _module, _names in (
    ("trend", trend, "ma macd dmi trix dma fsl expma bbi"), ("oscillator", oscillator, "rsi kdj cci roc mtm"),
    ("volume", volume, "vol_ma vol_tdx obv vr psy cr hsl lb"), ("volatility", volatility, "boll wr brar asi emv mcst"),
    ("cost", cost, "cyc cys"), ("breadth", breadth, "abi adl adr obos"),
):
    for _name in _names.split():
        register_indicator(_name, getattr(_module, _name), _category)
register_indicator("sar", recursive.sar, "trend")
for _name in ("abi", "adl", "adr", "obos"):
    register_indicator(_name, getattr(breadth, _name), "breadth", needs=("breadth",))
register_indicator("breadth", breadth.with_breadth, "breadth")
