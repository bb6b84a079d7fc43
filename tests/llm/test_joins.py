import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import ngram_join as nj
from quantloom.llm.components import connected_components
from quantloom.llm.embed_dedup import multi_sequence, near_dedup


from .conftest import clashing


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_join(rows, k, percent):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w and i is not None else set())
    n = range(len(rows))
    links = [(a, b) for a in n for b in n if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components(list(n), links)
    least = {}
    for a in n:
        if sets[a]:
            least[root[a]] = min(least.get(root[a], rows[a][0]), rows[a][0])
    return [(rows[a][0], least[root[a]] if sets[a] else rows[a][0]) for a in n]


def family(rng, base, i, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{i}_{rng.randrange(9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(spark):
    """A large group of near copies, chains, a passage that many share, and texts of their own."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(50)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, family(rng, base, i, rng.randrange(5))) for i in range(150)]
    rows += [(200 + i, " ".join(f"u{rng.randrange(300)}" for _ in range(rng.randint(1, 12))) + " " + passage) for i in range(60)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(20):
        rows.append((300 + i, " ".join(chain)))
        chain[5 * i % 100] = f"x{i}"
    rows += [(400 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 40)))) for i in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which,k,percent,hot", [("odd_docs", 4, 85, nj.HOT), ("no_docs", 4, 85, nj.HOT), ("copies", 4, 85, nj.HOT), ("copies", 5, 80, 7)])
def test_join_is_brute_force(which, k, percent, hot, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = nj.ngram_join(df, k, percent, hot).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(brute_join(rows, k, percent), key=str)


@pytest.mark.parametrize("own", [10, 13, 30])
def test_a_shared_passage_gives_no_pairs(spark, own):
    """Two thousand unlinked texts with one passage: what meets stays far below their number, let alone its square."""
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(i, " ".join(f"u{i}_{j}" for j in range(own)) + " " + passage) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shared = spark.sparkContext.broadcast(nj._profile(df, 4)[1])
    assert nj._meeting(nj._prefix_rows(df, 4, 85, shared), 85).count() < 200
    got = nj.ngram_join(df).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == own + 97 for r in got) and len(got) == 2000


def test_pieces_lose_no_meeting(spark, copies):
    """Dealing a frequent shingle's classes out in pieces keeps every meeting that one task would find."""
    shared = spark.sparkContext.broadcast(nj._profile(copies, 4)[1])
    rows = nj._prefix_rows(copies, 4, 85, shared, hot=10).cache()
    assert rows.filter("pieces > 1").count() > 100
    whole = nj._meeting(rows.withColumn("pieces", F.lit(1)), 85)
    cls = lambda df: {r.cls for r in df.select("cls").distinct().collect()}
    assert cls(whole) <= cls(nj._meeting(rows, 85))
    met = nj._met_by_size(rows.dropDuplicates(["token", "cls"]).withColumn("room", F.floor((F.col("n") - F.col("pos")) * 185 / 85) - F.col("n")), 85)
    one = nj._met_by_size(rows.limit(0).withColumn("room", F.lit(0)), 85)
    assert cls(whole) <= cls(met) and one.count() == 0


def test_one_of_each_group_stays(copies):
    rows = [(r.doc_id, r.text) for r in copies.collect()]
    assert sorted(r.doc_id for r in nj.keep_one(copies).collect()) == sorted(i for i, c in brute_join(rows, 5, 80) if i == c)


def test_one_row_of_each_group_stays_whatever_the_ids(spark, odd_docs, no_docs):
    long = next(r.text for r in odd_docs.filter("doc_id = 104").collect())
    more = [(None, None, "en", "s0", 0), (None, "no id here, only text", "en", "s0", 1), (101, "", "en", "s1", 0), (104, "an id that a near copy holds as well", "en", "s0", 1)]
    more += [(200, "one and the same row, but for a column", "en", s, 1) for s in ("s0", "s1", "s2")] + [(201, long, "en", "s1", 1), (201, "unlike its namesake in every word", "en", "s1", 1)]
    df = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    alone = [r for r in rows if r[0] is None]
    numbered = [(i, t) for i, (_, t) in enumerate(rows[: len(rows) - len(alone)])]
    want = alone + [rows[i] for i, c in brute_join(numbered, 5, 80) if i == c]
    got = nj.keep_one(df)
    assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert nj.keep_one(no_docs).count() == 0
    names = ("_keep", "_id", "_hash", "_turn", "cls", "component_id", "n_shingles")
    clash = nj.keep_one(clashing(df, *names))
    assert clash.columns == [*df.columns, *names] and clash.filter("_keep = 'mine' and _id = 'mine' and cls = 'mine'").count() == len(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(1, 40), min_size=1, max_size=30), min_size=1, max_size=12), st.sets(st.integers(1, 40), min_size=1, max_size=30), st.integers(30, 95))
def test_walk_finds_exactly_the_links(members, probe, percent):
    pack = lambda s: np.array(sorted(s), ">u8").tobytes()
    want = [i for i, m in enumerate(members) if 100 * len(m & probe) >= percent * len(m | probe)]
    assert sorted(nj.walk(pack(probe), list(enumerate(map(pack, members))), percent)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\raAbBé\x85\xa0", max_size=12), min_size=1, max_size=6))
def test_words_are_cut_at_ascii_spaces(texts):
    raw = [t.encode().lower() for t in texts]
    hashes, n = nj.word_hashes(raw)
    words = [w for t in raw for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in raw] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for e in links if e[0] != e[1] for x in e}, links)
    assert got.keys() == want.keys()
    assert len(set(zip(got.values(), (want[n] for n in got)))) == len(set(want.values())) == len(set(got.values()))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 8), st.integers(1, 20), st.integers(0, 999))
def test_multi_sequence_visits_nearest_cells(k, cells, seed):
    d1, d2 = np.random.default_rng(seed).random((2, k))
    got = [d1[i] + d2[j] for i, j in multi_sequence(d1, d2, cells)]
    assert np.allclose(got, np.sort((d1[:, None] + d2[None, :]).ravel())[:cells])


def test_embeddings_are_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:80] + rng.normal(size=(80, 16)) * 0.03, np.repeat(x[:3], 20, 0), x[5:6] * 7])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, []), (907, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_dedup(df, target_recall=1.0).collect()}
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    root = components(range(len(x)), np.argwhere(near).tolist())
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), root[i], root[i] == i)
    assert [got[i].n_links for i in range(900, 908)] == [0, 0, 0, 0, 1, 1, 0, 0] and got[905].component_id == 904
    assert near_dedup(spark.createDataFrame([], df.schema)).count() == 0


def test_default_recall_on_planted_pairs(spark):
    """Partners turned to a cosine just above the threshold, the hardest to find: at least 0.99 of the links at the default."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 32)) * np.linspace(1, 3, 32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = rng.uniform(0.951, 0.96, 3000)[:, None]
    every = np.concatenate([x, c * x + np.sqrt(1 - c**2) * u])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    y = every / np.linalg.norm(every, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    got = near_dedup(df).collect()
    assert all(r.n_links <= near[r.vec_id].sum() for r in got)
    assert sum(r.n_links for r in got) >= 0.99 * near.sum()


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_dedup(clashing(df, "id", "h", "ok", "cell", "n_links", "code")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, near_dedup(df).collect())) and {r.n_links for r in got} == {9}
