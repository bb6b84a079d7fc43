"""Trading costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commission rate, least commission, slippage, tax, transfer, handling and regulatory rates by market.
MARKETS = {
    "cn": {"commission": 0.0003, "least": 5.0, "slippage": 0.0001, "tax": 0.001, "transfer": 0.00002, "handling": 0.0000487, "regulatory": 0.00002},
    "hk": {"commission": 0.0008, "least": 100.0, "slippage": 0.0001, "tax": 0.001, "transfer": 0.0002, "handling": 0.00005, "regulatory": 0.00002},
    "us": {"commission": 0.0, "least": 0.0, "slippage": 0.0001, "tax": 0.0, "transfer": 0.0, "handling": 0.000119, "regulatory": 0.0000221},
    "plain": {"commission": 0.0003, "least": 5.0, "slippage": 0.0001, "tax": 0.001, "transfer": 0.0, "handling": 0.0, "regulatory": 0.0},
}


def breakdown(shares: Column, buy: Column, sell: Column, market: str = "plain") -> Column:
    """A struct of the parts of a round trip's cost, their total and the total over the traded amount. Slippage follows the
    price difference and may be negative; tax is on the sale, the other rates on both sides."""
    p = MARKETS[market]
    paid, got = shares * buy, shares * sell
    parts = {
        "commission": F.greatest(paid * p["commission"], F.lit(p["least"])) + F.greatest(got * p["commission"], F.lit(p["least"])),
        "tax": got * p["tax"], "slippage": shares * (sell - buy) * p["slippage"],
        "fees": (paid + got) * (p["transfer"] + p["handling"] + p["regulatory"]),
    }
    total = sum(parts.values(), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in parts.items()], total.alias("total"), F.try_divide(total, paid + got).alias("rate"))


def round_trip_cost(shares: Column, buy: Column, sell: Column) -> Column:
    return breakdown(shares, buy, sell)["total"]


def order_fills(kind: str, side: str, price: Column, limit: Column | None = None, stop: Column | None = None, triggered: Column | None = None) -> Column:
    """Whether an order fills at a price. triggered: whether a stop-limit order's stop was reached on or before the row
    (the running maximum of stop_reached)."""
    buy = side == "buy"
    within = (price <= limit if buy else price >= limit) if limit is not None else F.lit(True)
    if kind == "market":
        return F.lit(True)
    if kind == "limit":
        return within
    if kind == "stop":
        return stop_reached(side, price, stop)
    return triggered & within


def stop_reached(side: str, price: Column, stop: Column) -> Column:
    return price >= stop if side == "buy" else price <= stop
