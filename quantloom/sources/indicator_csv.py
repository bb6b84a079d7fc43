"""CSV files of indicators exported under several header names, and a CSV sink for comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names and the columns that they stand for.
ALIASES = {
    "日期": "date", "时间": "date", "DATE": "date", "Date": "date", "MA5": "ma5", "MA10": "ma10", "MA20": "ma20", "MA60": "ma60",
    "DIF": "macd", "DEA": "macd_signal", "MACD": "macd_hist", "RSI": "rsi14", "RSI14": "rsi14",
}
COLUMNS = ("ma5", "ma10", "ma20", "ma60", "macd", "macd_signal", "macd_hist", "rsi14")


def read_indicator_csv(spark: SparkSession, path: str) -> DataFrame:
    """date and those of COLUMNS that the header names (exactly, or by an alias); dates may be written with / or -, others are
    null; values that are no numbers are null. No pass is spent on inferring types."""
    session_case = spark.read.option("header", True).csv(path)
    found: dict[str, str] = {}
    for c in session_case.columns:
        found.setdefault(ALIASES.get(c, c), c)
    if "date" not in found:
        raise ValueError("the file has no column of dates")
    raw = session_case.toDF(*[f"_{i}" for i in range(len(session_case.columns))])  # headers may differ in case only
    at = {name: F.col(f"_{session_case.columns.index(c)}") for name, c in found.items()}
    day = F.try_to_date(F.replace(F.trim(at["date"]), F.lit("/"), F.lit("-")), "yyyy-M-d")
    return raw.select(day.alias("date"), *[at[c].try_cast("double").alias(c) for c in COLUMNS if c in at])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; files of a folder that is there are replaced."""
    df.write.mode("overwrite").option("header", True).csv(path)
