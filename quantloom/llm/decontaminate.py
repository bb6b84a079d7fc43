"""Benchmark decontamination: windows of test words are a broadcast hash set, training texts are scanned window by window.

Native: DataFrame functions only. Texts become lists of words (runs of letters, digits and non-ASCII characters, A-Z lowered).
An item's windows are its n consecutive words, or all of its words if it has fewer. Each word of a document is hashed once and
each window is a hash over the hashes of its words, for every window length that the benchmark has; the windows of a document
stream past the broadcast set within one stage, so nothing is shuffled but hits. A hit is verified by its words, so equal
hashes of different windows do no harm. A benchmark too large for one broadcast goes in blocks of `most` entries (windows
and the items that hold them), each with a pass of its own over the documents.

A document's words are held as one list in its task: some twenty times the text.

Defined cases: null or empty texts have no words, are not contaminated and make no windows; a null doc_id and rows that repeat
a doc_id are each treated by their own text; an item without an id marks words and is neither counted nor listed; items that
repeat an id count once; overlapping and repeated hits count a word once; extra columns pass through whatever their names, but
the columns added replace like-named ones; an empty benchmark hits nothing, an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_key, fresh, let, materialise, shuffle_free

#: A run of ASCII letters and digits and of characters beyond ASCII. The others are listed one by one: Java looks such a class up
#: in a table and asks each range of [^\x00-\x2F...] in turn, which takes about ten times as long.
WORD_RUN = "[^" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]+"


def words(text: Column) -> Column:
    """The words as comparison keys: equal exactly where the words are, A-Z lowered."""
    return F.regexp_extract_all(ascii_lower_key(F.coalesce(text, F.lit(""))), F.lit(WORD_RUN), F.lit(0))


def _hashes(of: Column) -> Column:
    return F.transform(of, lambda word: F.xxhash64(word))


def _runs(n_words: Column, length: Column) -> Column:
    """Places (from 1) at which a window of that length begins."""
    return F.when(n_words >= length, F.sequence(F.lit(1), n_words - length + 1)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """h, n_window, window, items: each distinct window with its hash, its words and the ids of the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))

    def windows(w: Column) -> Column:
        length = F.least(F.size(w), F.lit(n))
        return F.transform(_runs(F.size(w), length), lambda i: F.slice(w, i, length))

    each = items.filter(F.size("w") > 0).select("item", F.explode(let(F.col("w"), windows)).alias("window"))
    held = each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return held.select(F.xxhash64(_hashes(F.col("window"))).alias("h"), F.size("window").alias("n_window"), "window", "items")


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = 500_000) -> DataFrame:
    """_id, _t (hash of the text), at (the hits as structs of first word, from 0, and number of words), n_hit (distinct words
    inside them) and items (sorted ids) of the documents in which a window of the benchmark occurs."""
    windows = materialise(benchmark_windows(benchmark, n))
    lengths = sorted(r[0] for r in windows.select("n_window").distinct().collect())  # n of them at most
    entries = windows.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    blocks = max(1, -(-entries // most))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), words(F.col("text")).alias("w"))

    def of_length(h: Column, k: int) -> Column:
        return F.transform(_runs(F.size(h), F.lit(k)), lambda i: F.xxhash64(F.slice(h, i, k)))

    def hashed_windows(h: Column) -> Column:
        return F.concat(F.array().cast("array<bigint>"), *[of_length(h, k) for k in lengths])

    placed = rows.filter(F.size("w") > 0).select("_id", "_t", "w", F.posexplode(let(_hashes(F.col("w")), hashed_windows)).alias("p", "h"))
    before, start = F.lit(0), F.lit(-1)
    for k in lengths:  # the windows of each length follow those of the shorter ones
        start = F.when(F.col("n_window") == k, F.col("p") - before).otherwise(start)
        before = before + F.greatest(F.size("w") - k + 1, F.lit(0))
    hits = []
    for block in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod("h", F.lit(blocks)) == block)
        found = placed.join(F.broadcast(part), "h").withColumn("start", start)
        same = F.when(F.col("start").between(0, F.size("w") - F.col("n_window")), F.slice("w", F.col("start") + 1, F.col("n_window")) == F.col("window"))
        hits.append(found.filter(same).select("_id", "_t", "start", F.col("n_window").alias("n"), "items"))
    each = reduce(DataFrame.unionAll, hits).groupBy("_id", "_t").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    return each.select("_id", "_t", "at", F.size(hit_words(F.col("at"))).cast("long").alias("n_hit"), "items")


def hit_words(at: Column) -> Column:
    """Places (from 0) of the words inside any of the hits."""
    return F.array_distinct(F.flatten(F.transform(at, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))


def _without(text: Column, at: Column) -> Column:
    """text less the words hit, each with what stands between it and the next word."""

    def kept(parts: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), hit_words(at))
        return F.array_join(F.transform(places, lambda i: F.get(parts, i)), "")

    gaps = F.split(text, WORD_RUN, -1)  # one more than there are words
    following = F.slice(gaps, 2, F.size(gaps))
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0)), following, lambda word, gap: F.concat(word, gap))
    return F.concat(F.element_at(gaps, 1), let(parts, kept))


def _joined(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, dict[str, Column], Column]:
    """docs with the hits of each row, the columns to add by name, and the hits."""
    hits = materialise(window_hits(docs, benchmark, n))
    names = fresh(docs, *[f"_{c.strip('_')}" for c in hits.columns])
    i, t, at, n_hit, items = names
    small = shuffle_free(hits.toDF(*names), F.size(at) + F.size(items) + 4, 2_000_000)
    joined = docs.join(small, docs["doc_id"].eqNullSafe(small[i]) & (F.xxhash64(docs["text"]) == small[t]), "left")
    held = F.coalesce(F.col(items), F.array().cast("array<string>"))
    added = {"n_words": F.coalesce(F.regexp_count("text", F.lit(WORD_RUN)), F.lit(0)).cast("long"), "n_hit": F.coalesce(F.col(n_hit), F.lit(0)).cast("long"), "items": held}
    return joined, added, F.col(at)


def audit(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs plus n_words, n_hit (words inside hits) and items (sorted ids of the items with windows in the text)."""
    joined, added, _ = _joined(docs, benchmark, n)
    return joined.select(*[docs[c] for c in docs.columns if c not in added], *[c.alias(name) for name, c in added.items()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "spans") -> DataFrame:
    """docs without what the benchmark holds: the hit words, each with what stands between it and the next word ("spans"), or
    every document with a hit ("documents")."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    joined, _, at = _joined(docs, benchmark, n)
    if remove == "documents":
        return joined.filter(at.isNull()).select(*[docs[c] for c in docs.columns])
    text = F.when(at.isNull(), docs["text"]).otherwise(_without(docs["text"], at)).alias("text")
    return joined.select(*[text if c == "text" else docs[c] for c in docs.columns])
