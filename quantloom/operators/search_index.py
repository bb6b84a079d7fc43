"""Search by n-gram posting lists: any piece of a code, name or initials is found without reading the texts.

A posting is a gram of one to three characters, the row and field it stands in, and its places there. A text of m characters is
looked up by its grams of min(m, 3) characters; it stands where all of them do at consecutive places, which is exact, so nothing
is left to verify. Written postings are in order of grams: a search reads the row groups of its grams only.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONGEST = 3

# The first of GB2312's level-1 characters, which are sorted by sound, under each initial; the level ends at D7F9.
SOUNDS = {
    "A": 0xB0A1, "B": 0xB0C5, "C": 0xB2C1, "D": 0xB4EE, "E": 0xB6EA, "F": 0xB7A2, "G": 0xB8C1, "H": 0xB9FE, "J": 0xBBF7, "K": 0xBFA6, "L": 0xC0AC, "M": 0xC2E8,
    "N": 0xC4C3, "O": 0xC5B6, "P": 0xC5BE, "Q": 0xC6DA, "R": 0xC8BB, "S": 0xC8F6, "T": 0xCBFA, "W": 0xCDDA, "X": 0xCEF4, "Y": 0xD1B9, "Z": 0xD4D1,
}


def _sounds() -> tuple[str, str]:
    """Characters and their initials, as translate() takes them."""
    letters, starts = zip(*SOUNDS.items())
    codes = [code for code in range(starts[0], 0xD7F9 + 1) if code & 0xFF in range(0xA1, 0xFF)]
    return "".join(c.to_bytes(2, "big").decode("gb2312") for c in codes), "".join(letters[bisect_right(starts, c) - 1] for c in codes)


def initials(name: Column) -> Column:
    """The first letter or digit of each word, upper case; a Chinese character is a word and gives its sound's letter. A character with
    several sounds has the one that GB2312 sorts it by; rarer characters (its level 2) give none. Null stays null."""
    chars, letters = _sounds()
    apart = F.regexp_replace(name, r"([一-鿿])", " $1 ")
    words = F.filter(F.split(F.translate(apart, chars, letters), r"[^A-Za-z0-9]+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def _grams(text: Column, n: int) -> Column:
    """(place, gram) of each gram of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.struct(i.alias("place"), F.substring(text, i, F.lit(n)).alias("gram"))))


def postings(universe: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """The index: gram, key, field, places. fields: name of the field -> text; case is ignored, null and empty texts have no postings, equal
    rows count once. A row without a key is not found."""
    texts = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.upper(text.cast("string")).alias("text")) for name, text in fields.items()]))
    rows = universe.select(F.col(key).alias("key"), texts.alias("t")).filter("key IS NOT NULL AND length(t.text) > 0").select("key", "t.field", "t.text").distinct()
    each = [rows.select("key", "field", F.explode(_grams(F.col("text"), n)).alias("g")) for n in range(1, LONGEST + 1)]
    every = each[0].unionByName(each[1]).unionByName(each[2])
    return every.groupBy(F.col("g.gram").alias("gram"), "key", "field").agg(F.sort_array(F.collect_set("g.place")).alias("places"))


def write(index: DataFrame, path: str) -> None:
    """Postings in order of grams, those of a frequent gram over several files."""
    index.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(index: DataFrame, texts: list[str] | DataFrame, most: int | None = 50) -> DataFrame:
    """text, key, fields (comma-joined, in order) for each text searched and row that holds it; the first `most` rows of a text by key
    (the feature's own limit, None for all). texts: strings, for which the scan itself is filtered by their grams, or a frame with a
    column text. Blanks around a text are no part of it; empty and null texts find nothing, equal ones are one search."""
    spark = index.sparkSession
    asked = texts if isinstance(texts, DataFrame) else spark.createDataFrame([(t,) for t in texts], "text string")
    asked = asked.select(F.upper(F.trim("text")).alias("text")).filter("length(text) > 0").distinct()
    size = F.least(F.length("text"), F.lit(LONGEST))
    pieces = F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda i: F.struct((i - 1).alias("at"), F.substring(F.col("text"), i, size).alias("gram")))
    wanted = asked.select("text", F.size(pieces).alias("need"), F.explode(pieces).alias("p")).select("text", "need", "p.at", "p.gram")
    if not isinstance(texts, DataFrame):
        known = [t.strip().upper() for t in texts if t and t.strip()]
        index = index.filter(F.col("gram").isin(sorted({t[i : i + min(len(t), LONGEST)] for t in known for i in range(len(t) - min(len(t), LONGEST) + 1)})))
    starts = wanted.join(index, "gram").select("text", "need", "key", "field", F.explode(F.transform("places", lambda p: p - F.col("at"))).alias("start"))
    hits = starts.groupBy("text", "need", "key", "field", "start").agg(F.count("*").alias("n")).filter("n = need")
    rows = hits.groupBy("text", "key").agg(F.array_join(F.sort_array(F.collect_set("field")), ",").alias("fields"))
    if most is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("text").orderBy("key"))).filter(F.col("_n") <= most).drop("_n")
