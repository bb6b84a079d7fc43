"""A corpus pipeline of five stages; each stage's rows are written and read again before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import materialise
from quantloom.llm.langid import drop_unidentified, train
from quantloom.llm.line_dedup import line_dedup
from quantloom.llm.mixing import mix
from quantloom.llm.ngram_join import keep_one
from quantloom.llm.packing import best_fit_pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or between two, go. Null and empty texts and texts without letters are in no language; a null lang
    only keeps a row out of training; equal texts, whatever their ids, share one fate; no documents give no documents."""
    return drop_unidentified(docs, train(docs.select("text", "lang")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat over documents go from all but the largest doc_id; documents stay, also those left without a line. A null text
    comes back empty; rows without an id lose nothing and make no line frequent; repeated rows count as one document."""
    return line_dedup(docs).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, told apart by id and text: of equal rows one. Texts without words are linked
    with nothing and stay, and so does a row without an id that has no copy."""
    return keep_one(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate gives: rows without words never, rows of a null source by that source's rate, equal
    ids alike. All columns pass."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in training sequences. A null or empty text is one piece of its end token; repeated rows are packed each for
    itself; extra columns are not read."""
    return best_fit_pack(docs)


STAGES = [("language ID", language_id), ("line dedup", repeated_lines), ("n-gram Jaccard join", near_copies), ("source mixing", source_mix), ("best-fit packing", packing)]

#: SQL cannot express the language classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
