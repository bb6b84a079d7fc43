import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quantloom.llm.catalog import QUERIES
from quantloom.llm.decontaminate import audit, decontaminate

from .conftest import clashing

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def tokens(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in RUN.findall(text or "")]


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = tokens(text)
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = tokens(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= {str(y) for y in windows[x] if y is not None}
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, passage), (2, passage.upper() + " tail Ünd more"), (10, "short one"), (11, "Théta."), (12, ""), (13, None), (14, " ,;- "), (None, "no id at all"), (1, "another text of item one that has more than ten words in it")]
    return spark.createDataFrame(rows, ITEMS)


@pytest.fixture(scope="module")
def leaky(spark, odd_docs, items):
    passage = ", ".join(f"W{i}" for i in range(30))
    rows = [(200, f"clean start {passage} clean end"), (201, f"{passage[:40]}"), (202, passage + "\n" + passage), (203, "a SHORT\n\none b Short one"), (204, "théta THÉTA Théta"), (205, "xno id at all"), (206, "no id at ALL!"), (207, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (208, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 zz w14 w15"), (None, passage), (200, "same id, other text"), (202, passage + "\n" + passage)]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    return odd_docs.unionAll(spark.createDataFrame(rows, odd_docs.schema))


def test_audit_is_brute_force(leaky, items):
    want = brute([(r.doc_id, r.text) for r in leaky.collect()], [tuple(r) for r in items.collect()])
    assert got(audit(leaky, items)) == want
    assert sum(n > 0 for _, _, n, _ in want) > 8


def test_windows_in_blocks_give_the_same(leaky, items):
    from quantloom.llm.decontaminate import window_hits

    one, many = window_hits(leaky, items), window_hits(leaky, items, most=30)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(many) and one.count() >= 8


def test_real_tables(spark, sf_dir, docs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(audit(docs, bench)) == want and any(n for _, _, n, _ in want)
    rows = QUERIES["op13_benchmark_decontamination"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_hit, r.items_sha256, r.contaminated) for r in rows) == sorted((d, h, hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, _, h, i in want)


def test_empty_tables(spark, no_docs, odd_docs, items):
    assert audit(no_docs, items).collect() == []
    assert {(r.n_hit, tuple(r["items"])) for r in audit(odd_docs, spark.createDataFrame([], ITEMS)).collect()} == {(0, ())}


def test_removal(spark, leaky, items):
    dirty = {(d, t) for (d, t) in ((r.doc_id, r.text) for r in audit(leaky, items).filter("n_hit > 0").select("doc_id", "text").collect())}
    left = [(r.doc_id, r.text) for r in decontaminate(leaky, items, remove="documents").collect()]
    assert sorted(left, key=str) == sorted(((r.doc_id, r.text) for r in leaky.collect() if (r.doc_id, r.text) not in dirty), key=str)
    cut = decontaminate(leaky, items)
    assert cut.columns == leaky.columns and cut.count() == leaky.count()
    texts = {r.doc_id: r.text for r in cut.filter("doc_id in (203, 206, 207)").collect()}
    assert texts == {203: "a b ", 206: "", 207: "w0 w1 w2 w3 w4 w5 w6 w7 w8"}
    assert [r.text for r in cut.filter("doc_id = 200 and text like 'clean%'").collect()] == ["clean start clean end"]
    assert audit(cut, items).filter("n_hit > 0").count() == 0
    assert cut.filter("text is null").count() == leaky.filter("text is null").count()
    with pytest.raises(ValueError):
        decontaminate(leaky, items, remove="words")


def test_clashing_columns(leaky, items):
    names = ("_id", "_t", "at", "_at", "n_hit", "h", "p", "w", "window", "_items", "start")
    out = audit(clashing(leaky, *names), clashing(items, "h", "w", "items"))
    assert got(out) == got(audit(leaky, items))
    assert all(out.filter(F.col(c) != "mine").count() == 0 for c in names if c != "n_hit")


def test_nothing_is_shuffled_but_hits(leaky, items):
    from quantloom.llm.decontaminate import window_hits

    plan = window_hits(leaky, items)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan and "Arrow" not in plan


def test_words_are_found_by_table(spark):
    from time import perf_counter

    from quantloom.llm.decontaminate import WORD_RUN

    ranges = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    chars = spark.range(0x110000).filter("id not between 55296 and 57343").select(F.decode(F.expr("unhex(lpad(hex(id), 8, '0'))"), "UTF-32").alias("c"))
    assert chars.filter(F.col("c").rlike(WORD_RUN) != F.col("c").rlike(ranges)).count() == 0 and chars.filter(F.col("c").rlike(WORD_RUN)).count() > 1_000_000
    texts = spark.createDataFrame([("some words of English, and a few Numbers 123; " * 10_000,)] * 4, "text string")

    def seconds(pattern):
        began = perf_counter()
        assert texts.agg(F.sum(F.regexp_count("text", F.lit(pattern)))).first()[0] == 360_000
        return perf_counter() - began

    assert min(seconds(WORD_RUN) for _ in range(3)) < min(seconds(ranges) for _ in range(3)) / 2
