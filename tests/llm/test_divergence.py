import re
from collections import Counter, defaultdict
from itertools import pairwise

import pytest

from quantloom.llm import divergence
from quantloom.llm.divergence import divergences, heap_merge, pieces, term_frequencies

from .conftest import DOCS, clashing

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in TERM.findall(text or "")]


def brute(rows, min_docs, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, w = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        counts[lang, source].update(w)
        docs[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, r + 1) for part, rows in (("pair", pair), ("term", term)) for r, (v, item) in enumerate(rows)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def rows_of(df):
    return [(r.lang, r.source, r.text) for r in df.select("lang", "source", "text").collect()]


@pytest.mark.parametrize("min_docs", [1, 2, 10, 1000])
def test_odd_rows(odd_docs, min_docs):
    assert got(divergences(odd_docs, min_docs)) == brute(rows_of(odd_docs), min_docs)


def test_real_documents(docs):
    assert got(divergences(docs)) == (want := brute(rows_of(docs), 10)) and len(want) > 100


def test_small_blocks_chunks_and_shards_change_nothing(odd_docs, docs):
    for df in (odd_docs, docs.limit(60)):
        want = brute(rows := rows_of(df), 2)
        del rows
        assert got(divergences(df, 2, shards=3, block_bytes=300, chunk_entries=7)) == want
        assert got(divergences(df.repartition(5), 2, shards=1, block_bytes=10**9, chunk_entries=1)) == want


def test_many_sources_and_clashing_columns(spark):
    rows = [(i, " ".join(f"t{chr(97 + j)}" for j in range(i % 26)) + " x" * (i % 7), "en", f"s{i % 90}", 0) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute(rows_of(df), 5)
    assert got(divergences(df, 5)) == want
    assert got(divergences(clashing(df, "term", "i", "p", "n", "shard", "total"), 5)) == want


def test_sums_go_out_when_they_are_many(spark, monkeypatch):
    """Pairs beyond what is held leave as partial sums."""
    import pyarrow as pa

    rows = [("l", [(i, 10**8 + i, 5) for i in range(1, 1600)])]
    of = pa.array([r[1] for r in rows], pa.list_(pa.struct([("i", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())])))
    out = list(divergence._corrections([pa.RecordBatch.from_arrays([pa.array(["l"]), of], ["lang", "of"])] * 2))
    sums = Counter()
    for b in out:
        for _, x, y, v in zip(*(c.to_pylist() for c in b.columns)):
            sums[x, y] += v
    f = lambda a, b: (a - b) ** 2 // (a + b)
    assert len(out) > 1599 * 1598 // 2 // 65_536 + 2 and len(sums) == 1599 * 1598 // 2
    for x, y in ((1, 2), (5, 1500), (1598, 1599)):
        assert sums[x, y] == 2 * (f(10**8 + x, 10**8 + y) - f(10**8 + x, 5) - f(5, 10**8 + y))


def test_counts_beyond_a_long_product(spark):
    """Shares stay exact where 1e9 times a count leaves 64 bits."""
    df = spark.createDataFrame([(10**15, 3 * 10**15 + 7, 12345)], "c long, n long, v long")
    assert df.select(divergence._share("c", "n", "v")).first()[0] == 1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 7 + 2 * 12345)


def test_empty(no_docs):
    assert divergences(no_docs).collect() == []


def test_a_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 10)
    text = ("Alpha, beta-gamma " * 40 + "d" * 300 + " é").encode()
    parts = list(pieces(text))
    assert [t.decode() for p in parts for t in p] == terms_of(text.decode()) and len(parts) > 20


def test_merge_is_in_order_and_complete(odd_docs):
    chunks = [("en", b"a", ["s"], [[b"a", b"c"], [1, 2], [1, 1], [0, 0], [5, 6]]), ("en", b"b", ["t", "s"], [[b"b", b"c"], [1, 1], [2, 1], [0, 1, 1], [1, 2, 3]]), ("fr", b"a", ["s"], [[b"a"], [4], [0], [], []])]
    assert list(heap_merge(iter(chunks))) == [("en", b"a", 1, {"s": 5}), ("en", b"b", 1, {"t": 1, "s": 2}), ("en", b"c", 3, {"s": 9}), ("fr", b"a", 4, {})]
    terms = [r.term for r in term_frequencies(odd_docs, 1, shards=1).filter("lang = 'en'").collect()]
    assert all(a.encode() < b.encode() for a, b in pairwise(terms)) and len(terms) > 5
