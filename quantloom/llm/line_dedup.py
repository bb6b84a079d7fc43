"""Line dedup: lines that repeat over many documents are dropped, whole texts are reassembled by position.

Native: DataFrame functions only. Lines are keyed (trimmed, A-Z lowered), long keys are hashed (128 bits) and exploded,
distinct documents are counted per hash with partial aggregation on (hash, document), so that a line of a third of all
documents is counted in many tasks. The frequent keys are written as a table of their own before they meet the lines again:
they are broadcast when a count proves them few, and otherwise a join between two finished tables, which adaptive execution
splits where a key is hot. The positions to drop go back to the documents by a join whose build side holds positions only:
broadcast when a sum proves them few, shuffled otherwise.

Defined cases: null or empty text is one empty line; a null doc_id is never counted and loses no line; rows that repeat a
doc_id count once and are each treated by their own text; a text of any number of lines takes time in proportion; extra columns pass through whatever their names, but n_lines and
n_dropped are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower_key, broadcast_if_small, fresh, let, materialise, shuffle_free


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column, min_chars: int) -> Column:
    """Hash of each line's key in order, null for short keys."""
    trimmed = F.transform(_lines(text), lambda x: F.btrim(x, F.lit(SPACES)))
    return F.transform(trimmed, lambda x: F.when(F.char_length(x) >= min_chars, F.unhex(F.md5(ascii_lower_key(x).cast("binary")))))


def dropped_positions(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(_id, _text_hash, _drop): sorted line positions that each document loses; documents that lose none are absent."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"), _keys(F.col("text"), min_chars).alias("_keys"))
    rows = materialise(rows.filter(F.exists("_keys", lambda k: k.isNotNull())))  # hashes only: texts are parsed once
    placed = rows.select("_id", "_text_hash", F.posexplode("_keys").alias("_pos", "_key")).filter(F.col("_key").isNotNull())
    seen = rows.select("_id", F.explode(F.array_distinct(F.filter("_keys", lambda k: k.isNotNull()))).alias("_key"))
    frequent = materialise(seen.groupBy("_key").agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_keeper")).filter(F.col("_n") >= min_docs).drop("_n"))
    frequent = broadcast_if_small(frequent, 200_000)  # 24 bytes a row
    return placed.join(frequent, "_key").filter(F.col("_id") != F.col("_keeper")).groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))


def line_dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """docs with text rewritten, plus n_lines (before) and n_dropped. Lines kept are joined by newlines in their order."""
    drop = shuffle_free(materialise(dropped_positions(docs.select("doc_id", "text"), min_docs, min_chars)), F.size("_drop"), 2_000_000)
    i, h, lost = fresh(docs, "_id", "_text_hash", "_drop")
    drop = drop.select(F.col("_id").alias(i), F.col("_text_hash").alias(h), F.col("_drop").alias(lost))
    keyed = docs
    joined = keyed.join(drop, (keyed["doc_id"] == drop[i]) & (F.xxhash64(keyed["text"]) == drop[h]), "left")
    lines = _lines(keyed["text"])

    def without(split: Column) -> Column:
        # array_except of positions hashes and the text is split once, so a text of many lines stays linear
        kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lost))
        return F.array_join(F.transform(kept, lambda at: F.get(split, at)), "\n")

    rebuilt = F.when(F.col(lost).isNull(), F.coalesce(keyed["text"], F.lit(""))).otherwise(let(lines, without))
    other = [keyed[c] for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    out = joined.select(*other, rebuilt.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
