import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ctw
from quantloom.llm.common import crc_mod
from quantloom.llm.langid import codewords, drop_unidentified, predict, train

from .conftest import clashing


def test_codewords_keep_their_distance():
    for n in (2, 3, 4, 5, 9, 30):
        c = codewords(n)
        apart = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= (2 if n > 2 else 1) and (np.abs(c.sum(0)) < n).all()


def test_language_id(spark, docs, odd_docs, no_docs):
    fold = crc_mod(F.col("doc_id"), 4)
    model = train(docs.filter(fold != 2).select("text", "lang"))
    rows = predict(docs.filter(fold == 2), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if len(r.text) > 200]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {(r.doc_id, r.n_chars): r for r in predict(clashing(odd_docs, "score"), model).collect()}
    assert odd[100, None].lang_pred == odd[107, 3].lang_pred == odd[101, 0].lang_pred == "und" and odd[100, None].score == 0
    assert predict(no_docs, model).count() == 0
    none = train(no_docs.select("text", "lang"))
    assert {r.lang_pred for r in predict(docs, none).collect()} == {"und"}
    one = train(docs.filter("lang = 'en'").select("text", "lang"))
    assert {(r.lang_pred, r.score) for r in predict(docs, one).collect()} == {("en", 1.0)}
    kept = drop_unidentified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def brute_ctw(train_seqs, seq, depth):
    """Counts of every node by dictionary, weights by the recursion, prediction by walking the context."""
    counts = {}
    bits = lambda b: [((1 << k) | (b >> (8 - k)), (b >> (7 - k)) & 1) for k in range(8)]
    for s in train_seqs:
        p = bytes(depth) + s
        for i in range(depth, len(p)):
            for d in range(depth + 1):
                for z, bit in bits(p[i]):
                    counts.setdefault((p[i - d : i], z), [0, 0])[bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, own = {}, {}
    for ctx, z in sorted(counts, key=lambda k: -len(k[0])):
        own[ctx, z] = kt(*counts[ctx, z])
        kids = [weighted[c, z] for c in {bytes([x]) + ctx for x in range(256)} if (c, z) in weighted] if len(ctx) < depth else None
        weighted[ctx, z] = own[ctx, z] if kids is None else np.logaddexp(math.log(0.5) + own[ctx, z], math.log(0.5) + sum(kids))
    total, p = 0.0, bytes(depth) + seq
    for i in range(depth, len(p)):
        for z, bit in bits(p[i]):
            q, seen = None, False
            for d in range(depth, -1, -1):
                key = (p[i - d : i], z)
                n = counts.get(key, [0, 0])
                mine = (n[bit] + 0.5) / (sum(n) + 1)
                w = 1.0 if d == depth else math.exp(math.log(0.5) + own.get(key, 0.0) - weighted.get(key, 0.0)) if key in own else 0.5
                q = mine if not seen else w * mine + (1 - w) * q
                seen = sum(n) > 0
            total += math.log10(q)
    return total


def test_scores_are_brute_force(spark):
    texts = ["the cat sat", "The cat  ate the rat", "a rat sat\n", None, "", "éé the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id").isin(2, 5)
    body = lambda t: b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n"
    seqs = [body(t) for i, t in enumerate(texts) if i not in (2, 5)]
    words = [w for i, t in enumerate(texts) if i not in (2, 5) for w in [*(t or "").encode().lower().split(), "END"]]
    for bucket, shard in ((10_000, 10_000), (80, 10_000), (80, 6)):  # the last one splits contexts by one and two bytes more
        got = {r.doc_id: r for r in ctw.score(df, held, depth=3 if shard > 6 else 5, bucket_bytes=bucket, shard_bytes=shard).collect()}
        for i, t in enumerate(texts):
            own = [*(t or "").encode().lower().split(), "END"]
            base = sum(math.log10((words.count(w) + 0.5) / (len(words) + 0.5 * (len(set(words)) + 1))) for w in own)
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(own), sum(w in words for w in own), len(words), i in (2, 5))
            assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(brute_ctw(seqs, body(t), 3 if shard > 6 else 5), rel=1e-5)


def test_default_depth_is_six_bytes(spark):
    texts = ["xabcdef1 yabcdef2", "xabcdef1 yabcdef2 xabcdef1", "yabcdef2 xabcdef1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    body = lambda t: t.encode() + b" \n"
    got = {r.doc_id: r.score for r in ctw.score(df, F.col("doc_id") == 2).collect()}
    seqs = [body(t) for t in texts[:2]]
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_ctw(seqs, body(t), 6), rel=1e-5)
        assert got[i] != pytest.approx(brute_ctw(seqs, body(t), 5), rel=1e-5)


def test_scores_of_odd_tables(spark, odd_docs, no_docs, docs):
    held = crc_mod(F.col("doc_id"), 5) == 1
    assert ctw.score(no_docs, held).count() == 0
    rows = ctw.score(clashing(odd_docs, "bucket", "score"), held).collect()
    assert len(rows) == odd_docs.count() and all(r.score < 0 for r in rows)
    assert ctw.score(docs, F.lit(True)).filter("n_known > 0 or train_tokens > 0").count() == 0


def test_crowded_contexts_are_split(spark, docs):
    rows = docs.select("doc_id", "text")
    total = sum(len((r.text or "").encode()) for r in rows.collect())
    split = ctw._crowded(rows, total, 6, total // 100, 1 << 30)
    assert set(split) >= {2} and all(len(v) <= 400 for v in split.values())
    words, grams = np.array([5, 9], np.uint64), np.unique(ctw.read([r.text for r in rows.limit(50).collect()], 6)[2])
    parts = list(ctw._dealt(words, grams, 8, split))
    assert sorted(np.concatenate([p for kind, _, p in parts if kind]).tolist()) == list(range(len(grams)))
    assert {kind for kind, _, _ in parts} >= {0, 2, 3}
    for kind, shard, at in parts:  # one shard holds all grams of a context
        if kind:
            mine = set(((grams[at] & ctw._low(kind)) >> np.uint64(8)).tolist())
            assert not any(mine & set(((grams[p] & ctw._low(kind)) >> np.uint64(8)).tolist()) for k, s, p in parts if k == kind and s != shard)


def test_large_counts_meet_the_table():
    n = np.array([0, 3, ctw.SMALL - 2, ctw.SMALL, 10 * ctw.SMALL])
    want = [math.lgamma(a + 0.5) + math.lgamma(7.5) - math.lgamma(a + 8) - math.log(math.pi) for a in n.tolist()]
    assert np.allclose(ctw.log_kt(n, np.full(5, 7)), want, atol=1e-6)


@pytest.mark.parametrize("depth", [3, 7])
def test_probabilities_add_up_to_one(depth):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 101, 400).astype(np.uint64)
    grams = sum(text[depth - j : len(text) - j] << np.uint64(8 * j) for j in range(depth + 1))
    keys, counts = np.unique(grams, return_counts=True)
    every = np.unique(np.concatenate([keys, (keys[:, None] >> np.uint64(8) << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()]))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, keys)] = counts
    tree = ctw.Subtrees(every, n, depth)
    p = 10 ** tree.log10(ctw.Top(*tree.roots()))
    assert np.allclose(np.bincount(np.unique(every >> np.uint64(8), return_inverse=True)[1], p), 1)


def test_texts_without_letters_are_undetermined(spark, docs):
    """Signs, digits and numerals of any script are no letters; one letter anywhere in the text is enough."""
    model = train(docs.select("text", "lang"))
    rows = ["²", "½ ½", "①", "Ⅷ", "12 345 !!", "_", "\u0301", "ª", "5" * 5000 + "a", "語", "é"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r.doc_id: r for r in predict(df, model).collect()}
    assert [got[i].lang_pred == "und" for i in range(len(rows))] == [True] * 7 + [False] * 4
    assert all(got[i].score == 0 for i in range(7))


def test_decoding_is_brute_force(spark, docs):
    """Each prediction again, gram by gram and bit by bit, from the model's tables."""
    model = train(docs.select("text", "lang"))
    rows = predict(docs.limit(40), model).collect()
    for r in rows:
        b = r.text.encode().lower() + b"\0\0\0"
        sums = [0.0] * model.code.shape[1]
        n = len(b) - 2
        for i in range(n):
            two = b[i] << 8 | b[i + 1]
            three = two << 8 | b[i + 2]
            for x, m in ((two, 2654435761), (three, 2246822519)):
                odds = model.odds[((x * m) & 0xFFFFFFFF) >> 17]
                sums = [s + float(o) for s, o in zip(sums, odds)]
        margins = [s / (2 * n) * min(n, 40.0) for s in sums]
        losses = []
        for code, trust in zip(model.code, model.trust):
            losses.append(sum(t * math.log1p(math.exp(-m * c)) for m, c, t in zip(margins, code, trust)) / sum(trust))
        best = min(range(len(losses)), key=losses.__getitem__)
        assert r.lang_pred == model.languages[best]
        assert r.score == pytest.approx(1 / sum(math.exp(min(losses) - x) for x in losses), abs=1e-4)
