"""DuckDB SQL for the oracle: bars as common table expressions and stages of window expressions over them."""

from __future__ import annotations

BARS_HOUR = """
  SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS date, (min((ts, value)))[2] AS open, max(value) AS high,
         min(value) AS low, (max((ts, value)))[2] AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount
  FROM (SELECT event_type, ts, CAST(value AS DOUBLE) AS value FROM events) GROUP BY ALL"""

BARS_WEEK = """
  SELECT symbol, date, (min(pos))[4] AS open, max(p) AS high, min(p) AS low, (max(pos))[4] AS close, sum(q) AS volume, sum(a) AS amount
  FROM (SELECT l_suppkey AS symbol, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS date,
               CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS p, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS a,
               row(CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS pos
        FROM lineitem) GROUP BY symbol, date"""

BARS_TICK = """
  SELECT event_type AS symbol, ts AS date, v AS open, v AS high, v AS low, v AS close, floor(v) + 1 AS volume, v * (floor(v) + 1) AS amount
  FROM (SELECT event_type, ts, CAST(value AS DOUBLE) AS v FROM events)"""

#: Added before rounding on both sides: means of two-digit prices often lie exactly between two rounded values, where the
#: last bit of a sum would decide.
NUDGE = 1.37e-8

OVER = "OVER (PARTITION BY symbol ORDER BY date{})"


def last(expr: str, n: int) -> str:
    """An aggregate over the current row and the n-1 before it."""
    return f"{expr} " + OVER.format(f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def prior(expr: str, n: int, to: int = 1) -> str:
    return f"{expr} " + OVER.format(f" ROWS BETWEEN {n} PRECEDING AND {to} PRECEDING")


def so_far(expr: str) -> str:
    return f"{expr} " + OVER.format(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


def lag(expr: str, n: int = 1) -> str:
    return f"lag({expr}, {n}) " + OVER.format("")


def ewm(c: str, span: int) -> str:
    """Weights of (1-a)^-i instead of (1-a)^(n-i): the same ratio. i: row number, a stage before."""
    r = repr(1 - 2 / (span + 1))
    return f"{so_far(f'sum({c} * pow({r}, -i))')} / {so_far(f'sum(CASE WHEN {c} IS NOT NULL THEN pow({r}, -i) END)')}"


def staged(stages: list[dict[str, str]], columns: list[str], bars: str = BARS_HOUR, where: str = "", keys: str = "symbol, date", digits: int = 6) -> str:
    """SELECT keys and rounded columns after adding each stage's expressions (row number i first)."""
    ctes = [f"bars AS ({bars})", "s0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars)"]
    for n, stage in enumerate(stages, 1):
        ctes.append(f"s{n} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in stage.items()) + f" FROM s{n - 1})")
    picked = ", ".join(f"round({c} + {NUDGE}, {digits}) AS {c}" if not c.endswith("!") else c[:-1] for c in columns)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {keys}, {picked} FROM s{len(stages)} {where}"
