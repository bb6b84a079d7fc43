"""Dividend adjustment: event factors, factor series and adjusted prices; dividend hygiene.

Events are few against bars but have no proven bound, so they join by symbol through shuffles that adaptive execution may
turn into broadcasts by measured size; each event meets its symbol's bars only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..windows import KEY, TIME, so_far

PRICES = ("open", "high", "low", "close")


def event_factor(p0: Column, cash: Column, share: Column, rights_ratio: Column, rights_price: Column, live: bool = False) -> Column:
    """(P0 - D + R Pr) / (P0 (1 + S + R)); a ratio above 2 is per ten shares; null unless positive. live: no rights issue,
    no per-ten rule, no cash at or above P0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    if live:
        f = F.try_divide(p0 - zero(cash), p0 * (1 + zero(share)))
        return F.when((p0 > 0) & (zero(cash) < p0), f)
    per_ten = lambda c: F.when(zero(c) > 2, zero(c) / 10).otherwise(zero(c))
    s, r = per_ten(share), per_ten(rights_ratio)
    f = F.try_divide(p0 - zero(cash) + r * zero(rights_price), p0 * (1 + s + r))
    return F.when((p0 > 0) & (f > 0), f)


def with_event_factors(bars: DataFrame, events: DataFrame, live: bool = False) -> DataFrame:
    """events plus p0 (the last close before ex_date) and factor. Bars and events of a symbol are put in one time order, so
    the as-of lookup is a window and not a range join."""
    b = bars.select(KEY, F.col(TIME).alias("_t"), F.lit(1).alias("_kind"), "close", *[F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c != KEY])
    e = events.select(KEY, F.col("ex_date").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("close"), *[c for c in events.columns if c != KEY])
    order = Window.partitionBy(KEY).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)  # events come before bars of their day
    found = b.unionByName(e).withColumn("p0", F.last("close", True).over(order)).filter("_kind = 0")
    factor = event_factor(F.col("p0"), F.col("cash_div"), F.col("share_div"), F.col("rights_issue_ratio"), F.col("rights_issue_price"), live)
    return found.select(*events.columns, "p0", factor.alias("factor"))


def adjustment_factors(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """bars plus qfq_factor (product of the factors of later ex-dates) and hfq_factor (product of the inverse factors up to
    the date). Events of a day act together; the running product is a window over the symbol's bars and events."""
    day = factors.filter("factor is not null").groupBy(KEY, F.col("ex_date").alias("_t")).agg(F.product("factor").alias("_f"))
    keep = [c for c in bars.columns if c not in (KEY, "qfq_factor", "hfq_factor")]
    b = bars.select(KEY, F.col(TIME).alias("_t"), F.lit(1).alias("_kind"), F.lit(1.0).alias("_f"), *keep)
    e = day.select(KEY, "_t", F.lit(0).alias("_kind"), "_f", *[F.lit(None).cast(t).alias(c) for c, t in bars.dtypes if c in keep])
    at = Window.partitionBy(KEY).orderBy("_t", "_kind")
    later, before = at.rowsBetween(1, Window.unboundedFollowing), at.rowsBetween(Window.unboundedPreceding, 0)
    out = b.unionByName(e).withColumns({"qfq_factor": F.coalesce(F.product("_f").over(later), F.lit(1.0)), "hfq_factor": 1 / F.product("_f").over(before)})
    return out.filter("_kind = 1").select(*bars.columns, "qfq_factor", "hfq_factor")


def apply_factors(bars: DataFrame, factors: DataFrame, fill: bool = False) -> DataFrame:
    """bars with qfq_* and hfq_* prices from a factor table (symbol, date, qfq_factor, hfq_factor); a missing factor is 1,
    or the last one before it with fill."""
    df = bars.join(factors.select(KEY, TIME, "qfq_factor", "hfq_factor"), [KEY, TIME], "left")
    for f in ("qfq_factor", "hfq_factor"):
        df = df.withColumn(f, F.coalesce(F.last(f, True).over(so_far()) if fill else F.col(f), F.lit(1.0)))
    return with_adjusted_prices(df)


def with_adjusted_prices(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{k}_{p}": F.col(p) * F.col(f"{k}_factor") for k in ("qfq", "hfq") for p in PRICES})


def swap_prices(df: DataFrame, adjust: str = "none") -> DataFrame:
    """The adjusted prices in the place of the raw ones (none, qfq or hfq); a missing adjusted price stays raw."""
    return df if adjust == "none" else df.withColumns({p: F.coalesce(f"{adjust}_{p}", p) for p in PRICES})


def adjusted_price(daily: DataFrame, factors: DataFrame, adjust: str = "qfq", start=None, end=None) -> DataFrame:
    """symbol, date, open, high, low, close, factor, source of each symbol between the dates, by the first source that has it:
    the factor table, else adjusted columns of the daily table (if any of the symbol's closes is there), else raw prices.
    adjust: none, qfq or hfq. One shuffle by symbol."""
    between = (F.lit(True) if start is None else F.col(TIME) >= start) & (F.lit(True) if end is None else F.col(TIME) <= end)
    daily = daily.filter(between)
    raw = [*[F.col(p) for p in PRICES], F.lit(None).cast("double").alias("factor"), F.lit("raw").alias("source")]
    if adjust == "none":
        return daily.select(KEY, TIME, *raw)
    if adjust not in ("qfq", "hfq"):
        raise ValueError(f"unknown adjustment {adjust}")
    names = [f"{adjust}_{p}" for p in (*PRICES, "factor")]
    own = lambda df, source: df.select(KEY, TIME, *[F.col(n).alias(p) for n, p in zip(names, (*PRICES, "factor"))], F.lit(source).alias("source"))
    every = own(factors.filter(between), "factor").withColumn("_rank", F.lit(1))
    here = daily.columns
    if set(names) <= set(here):
        every = every.unionByName(own(daily, "daily").withColumn("_rank", F.lit(2)))
    every = every.unionByName(daily.select(KEY, TIME, *raw).withColumn("_rank", F.lit(3)))
    usable = (F.col("source") != "daily") | F.col("close").isNotNull()  # a symbol's daily rows count if one close is there
    best = F.min(F.when(usable, F.col("_rank"))).over(Window.partitionBy(KEY))
    return every.withColumn("_best", best).filter("_rank = _best").drop("_rank", "_best")


def latest_price(prices: DataFrame) -> DataFrame:
    """Each symbol's last row."""
    last = F.max_by(F.struct(*[c for c in prices.columns if c != KEY]), TIME).alias("_r")
    return prices.groupBy(KEY).agg(last).select(KEY, "_r.*")


def price_change(prices: DataFrame, days: int = 20) -> DataFrame:
    """symbol, latest_close, past_close (the days-th close from the end), change, pct_change (0 for a past close of 0); symbols
    with fewer bars are absent."""
    k = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))
    at = lambda n: F.max(F.when(F.col("_k") == n, F.col("close")))
    two = prices.withColumn("_k", k).filter(F.col("_k") <= days).groupBy(KEY).agg(at(1).alias("latest_close"), at(days).alias("past_close"), F.count("*").alias("_n")).filter(F.col("_n") == days)
    change = F.col("latest_close") - F.col("past_close")
    return two.select(KEY, "latest_close", "past_close", change.alias("change"), F.when(F.col("past_close") == 0, 0.0).otherwise(F.try_divide(change * 100, "past_close")).alias("pct_change"))


# Names under which a source gives amounts for ten shares (the first three) or as they are.
PER_TEN = {
    "cash_div": ("现金分红-现金分红比例", "每10股派息(税前)", "每10股派息"),
    "share_div": ("送转股份-送转总比例", "每10股送转", "每10股送股", "每10股转增"),
    "rights_issue_ratio": ("配股比例", "每10股配股比例", "10配股"),
}
AS_GIVEN = {"rights_issue_price": ("配股价格", "配股价"), "total_div": ("总派现金额(含税)", "派现总额", "分红总额")}


def parse_per_ten(df: DataFrame) -> DataFrame:
    """Dividend columns a share from a source's own columns: the first name that has a number; nothing found is 0."""
    def pick(names: tuple[str, ...]) -> Column:
        found = [F.col(f"`{n}`").try_cast("double") for n in names if n in df.columns]
        return F.coalesce(*found, F.lit(0.0))

    rest = [F.col(f"`{c}`") for c in df.columns if not any(c in names for names in (*PER_TEN.values(), *AS_GIVEN.values()))]
    return df.select(*rest, *[(pick(n) / 10).alias(c) for c, n in PER_TEN.items()], *[pick(n).alias(c) for c, n in AS_GIVEN.items()])


#: What makes two dividends without an ex-date the same one, besides the symbol.
UNDATED = ("dividend_year", "report_date", "record_date", "cash_div", "share_div", "total_div", "rights_issue_price", "rights_issue_ratio")


def clean_dividends(df: DataFrame) -> DataFrame:
    """Negative amounts become 0, negative rights terms null; one row a (symbol, ex_date), the latest by updated_at and id, and
    of rows without an ex-date one for each set of the other terms; the dividend year follows the ex-date where it is missing."""
    df = df.withColumns({**{c: F.greatest(F.col(c), F.lit(0.0)) for c in ("cash_div", "share_div")}, **{c: F.when(F.col(c) >= 0, F.col(c)) for c in ("rights_issue_price", "rights_issue_ratio")}})
    terms = F.when(F.col("ex_date").isNull(), F.struct(*[c for c in UNDATED if c in df.columns]))
    newest = Window.partitionBy(KEY, "ex_date", "_terms").orderBy(F.desc("updated_at"), F.desc("id"))
    dated = df.withColumn("_terms", terms).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_terms")
    return dated.withColumn("dividend_year", F.coalesce("dividend_year", F.year("ex_date")))


def rights_ratio(text: Column) -> Column:
    """'10:3' gives 0.3; a plain number stays; anything else is null."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    first, second = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    return F.when(text.rlike(r"^\s*\d+(\.\d+)?\s*[:：]\s*\d+(\.\d+)?\s*$"), F.try_divide(second, first)).when(F.size(parts) == 1, first)


def bar_index(bars: DataFrame, events: DataFrame) -> DataFrame:
    """events plus the position of the ex-date's bar among the symbol's bars, from 0; -1 where there is none."""
    at = bars.select(KEY, F.col(TIME).alias("ex_date"), (F.row_number().over(Window.partitionBy(KEY).orderBy(TIME)) - 1).alias("bar_index"))
    return events.join(at, [KEY, "ex_date"], "left").withColumn("bar_index", F.coalesce("bar_index", F.lit(-1)))
