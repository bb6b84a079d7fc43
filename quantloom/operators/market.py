"""Market lists, universe merging, classification and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..windows import KEY, TIME, ratio


def market_list(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol with change, pct_chg and amplitude against the close before it."""
    last = Window.partitionBy(KEY).orderBy(F.desc(TIME))
    two = bars.withColumns({"_n": F.row_number().over(last), "prev_close": F.lead("close").over(last)}).filter("_n = 1").drop("_n")
    change = F.col("close") - F.col("prev_close")
    return two.withColumns({"change": change, "pct_chg": ratio(change * 100, "prev_close"), "amplitude": ratio((F.col("high") - F.col("low")) * 100, "prev_close")})


def search(universe: DataFrame, text: str, columns: tuple[str, ...] = ("symbol", "name"), most: int = 50) -> DataFrame:
    """Rows where a column contains the text, case ignored; the first `most` by symbol (the feature's own limit)."""
    needle = text.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle)), F.lit(False))
    return universe.filter(hit).orderBy(columns[0]).limit(most)


def merge_universe(base: DataFrame, override: DataFrame, key: str = KEY) -> DataFrame:
    """Full outer merge; non-blank values of override win."""
    rest = [c for c in base.columns if c != key]
    other = override.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in rest])
    joined = base.join(other, base[key].eqNullSafe(other["_key"]), "full_outer")
    filled = lambda c: F.nullif(F.trim(F.col(f"_{c}").cast("string")), F.lit("")).cast(dict(base.dtypes)[c])
    return joined.select(F.coalesce(key, "_key").alias(key), *[F.coalesce(filled(c), F.col(c)).alias(c) for c in rest])


def fill_blanks(old: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """Full outer merge that keeps old values and fills only blank ones; rows of new alone are inserted."""
    return merge_universe(new.select(*old.columns), old, key)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of new in place of rows of old with equal keys, and all others."""
    return old.join(new.select(*keys).distinct(), [old[k].eqNullSafe(new[k]) for k in keys], "left_anti").unionByName(new.select(*old.columns))


def board(code: Column) -> Column:
    """Market segment by the digits of an exchange code."""
    c = F.regexp_extract(code, r"(\d{6})", 1)
    return (
        F.when(c.rlike("^68[89]"), "STAR").when(c.rlike("^60"), "Shanghai main").when(c.rlike("^30"), "ChiNext")
        .when(c.rlike("^00"), "Shenzhen main").when(c.rlike("^(4|8|92)"), "Beijing").when(c.rlike("^(5|15|16|18)"), "fund").otherwise("other")
    )


# What a code's suffix and words in an index's name stand for, the first match in order.
PUBLISHERS = {"SH": "上交所", "SZ": "深交所", "BJ": "北交所"}
INDEX_KINDS = (
    (("行业",), "行业指数", "行业"), (("主题",), "主题指数", "主题"), (("红利",), "策略指数", "红利"), (("创业板",), "板块指数", "创业板"),
    (("科创",), "板块指数", "科创板"), (("北证",), "板块指数", "北交所"), (("中证", "沪深", "上证", "深证"), "综合指数", "宽基"),
)
FUND_CODES = {"SH": ("50", "51", "52", "56", "58"), "SZ": ("15", "16", "18")}
FUND, WEIGHTS, OTHER = "基金", "市值加权", ("交易所", "综合指数", "通用")


def index_meta(code: Column, name: Column) -> Column:
    """publisher, index_type, category and weight_rule of an index by its code (number.suffix) and name."""
    suffix, text = F.upper(F.element_at(F.split(code, r"\."), -1)), F.coalesce(F.trim(name), F.lit(""))
    publisher, kind, category = (F.lit(x) for x in OTHER)
    for s, p in PUBLISHERS.items():
        publisher = F.when(F.contains(code, F.lit(".")) & (suffix == s), p).otherwise(publisher)
    for words, k, c in reversed(INDEX_KINDS):
        hit = text.rlike("|".join(words))
        kind, category = F.when(hit, k).otherwise(kind), F.when(hit, c).otherwise(category)
    return F.struct(publisher.alias("publisher"), kind.alias("index_type"), category.alias("category"), F.lit(WEIGHTS).alias("weight_rule"))


def fund_type(code: Column, name: Column, market: Column | None = None) -> Column:
    """ETF, LOF or the plain word for a fund; null for codes that are no funds."""
    number, suffix = F.split_part(code, F.lit("."), F.lit(1)), F.upper(F.regexp_extract(code, r"\.(.*)$", 1))
    text, place = F.upper(F.coalesce(F.trim(name), F.lit(""))), F.coalesce(F.trim(market), F.lit("")) if market is not None else F.lit("")
    coded = F.lit(False)
    for s, starts in FUND_CODES.items():
        coded = coded | ((suffix == s) & number.rlike(f"^({'|'.join(starts)})"))
    fund = F.contains(code, F.lit(".")) & (coded | F.contains(place, F.lit(FUND)) | text.rlike(f"ETF|LOF|{FUND}"))
    return F.when(fund, F.when(F.contains(text, F.lit("ETF")), "ETF").when(F.contains(text, F.lit("LOF")) | number.rlike("^(16|18)"), "LOF").otherwise(FUND))


def normalise_text(c: Column, most: int = 100) -> Column:
    """Trimmed and cut text; blanks and place-holders are null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "nan", "none", "null", "--", "-"), F.substring(t, 1, most))


def normalise_date(c: Column) -> Column:
    """Dates written 2024-01-31, 20240131 or 2024/01/31; anything else is null."""
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")])


def compare(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """column, n, max_diff, mean_diff, n_over of two frames joined on symbol and date."""
    other = b.select(KEY, TIME, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = a.select(KEY, TIME, *columns).join(other, [KEY, TIME])
    long = joined.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(c) - F.col(f"_{c}")).alias("d")) for c in columns])).alias("p")).select("p.*").filter("d is not null")
    return long.groupBy("column").agg(F.count("*").alias("n"), F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff"), F.count_if(F.col("d") > tolerance).alias("n_over"))


def trade_span(bars: DataFrame) -> DataFrame:
    """First and last date of each symbol."""
    return bars.groupBy(KEY).agg(F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date"))


def backfill_list_date(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """list_date, or the symbol's first bar where it is missing."""
    return universe.join(trade_span(bars).select(KEY, F.col("first_date").cast("date").alias("_first")), KEY, "left").withColumn("list_date", F.coalesce("list_date", "_first")).drop("_first")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
