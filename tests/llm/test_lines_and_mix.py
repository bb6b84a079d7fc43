import hashlib
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm.line_dedup import line_dedup
from quantloom.llm.mixing import mix, mix_plan, size_of

from .conftest import clashing

SPACES = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_docs=5, min_chars=40):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    holders = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            k = lower(x.strip(SPACES))
            if len(k) >= min_chars and i is not None:
                holders[k].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(h := holders.get(lower(x.strip(SPACES)), ())) >= min_docs and max(h) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "docs"])
def test_line_dedup_is_brute_force(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(df).collect()]
    assert sorted(got, key=str) == brute_lines(rows)


def test_line_keys_fold_ascii_case_only(spark):
    base = "é" * 20 + "X" * 20 + "Ã"
    same = [(i, s) for i, s in enumerate([base, base.lower().replace("ã", "Ã"), f"  {base}\r"])]
    other = [(10 + i, s) for i, s in enumerate([base.replace("Ã", "ã"), base.replace("é", "É")])]
    df = spark.createDataFrame(same + other, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup(df, min_docs=3).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 10: 0, 11: 0}


def test_clashing_columns_pass(odd_docs):
    names = ("_key", "_keys", "_pos", "_text_hash", "_id", "_drop", "__drop", "keeper")
    out = line_dedup(clashing(odd_docs, *names))
    assert out.columns == [*odd_docs.columns, *names, "n_lines", "n_dropped"] and out.count() == odd_docs.count()
    assert all(out.filter(f"{c} <> 'mine'").count() == 0 for c in names)
    assert sorted(out.select("doc_id", "text").collect(), key=str) == sorted(line_dedup(odd_docs).select("doc_id", "text").collect(), key=str)
    names = ("size", "_size", "target", "copies", "rate", "_rate", "_source", "_copies", "_copy", "col")
    out = mix(clashing(odd_docs, *names))
    assert out.columns == [*odd_docs.columns, *names] and out.count() == mix(odd_docs).count()
    assert all(out.filter(f"{c} <> 'mine'").count() == 0 for c in names)
    assert mix_plan(clashing(odd_docs, "_size", "size", "_rate")).filter("_size = 'mine' and size >= 0").count() == odd_docs.count()


def fill(sizes, share=1.5, most=2.0):
    """Targets by the rule as it is told: share by weight, cap, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = dict(zip(names, [(3, 1, 2)[i % 3] for i in range(len(names))]))
    capped, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: most * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "docs"])
def test_mixing_targets(which, request):
    df = request.getfixturevalue(which)
    plan = mix_plan(df).collect()
    sizes = defaultdict(int)
    for r in plan:
        assert r.size == len((r.text or "").split()) and r.copies * r.size <= 2 * r.size
        sizes[r.source] += r.size
    target = fill(sizes) if sizes else {}
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert sorted(str((r.doc_id, r.copies)) for r in plan) == sorted(str((r.doc_id, r.copies)) for r in mix_plan(df.repartition(3)).collect())
    assert mix(df).count() == sum(r.copies for r in plan) and mix(df).columns == df.columns


def test_taken_words_come_near_their_targets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.lit("a b c d e").alias("text"))
    rows = mix_plan(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in rows)
    assert df.select(size_of(F.lit("  a\x0bb c\n")).alias("n")).first().n == 2


def test_query_hashes_texts(spark, sf_dir):
    from quantloom.llm.catalog import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, sf_dir).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i, n, dropped, text in brute_lines(docs):
        assert (rows[i].n_lines, rows[i].n_dropped, rows[i].kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


def test_very_many_lines_take_linear_time(spark):
    """One document of 200,000 lines loses one of them."""
    line = "This line is held by five documents of the table and goes."
    long = "\n".join([*(f"line {i}" for i in range(100_000)), line, *(f"line {i}" for i in range(100_000, 199_999))])
    df = spark.createDataFrame([(1, long)] + [(i, f"{line}\n{i}") for i in range(2, 7)], "doc_id long, text string")
    line_dedup(df.filter("doc_id > 1")).collect()  # compiles
    began = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    assert time.perf_counter() - began < 10
    assert (got[1].n_lines, got[1].n_dropped, got[1].text) == (200_000, 1, long.replace(f"\n{line}", ""))
