import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import chat
from quantloom.llm.token_counts import RollupStore, count_tokens, count_words, deletes, entries, revisions, upserts

from .conftest import clashing

LEGAL = {0: {1, 2}, 1: {2}, 2: {3}, 3: {2}}


def brute_cost(roles, costs=chat.COSTS):
    """Least cost over every choice of role or merge for each turn and the insertions that it then needs."""
    least_gap = {}
    for a in range(4):
        for b in (1, 2, 3):
            for n in range(4):
                if any(all(y in LEGAL[x] for x, y in zip((a, *mid), (*mid, b))) for mid in itertools.product((2, 3), repeat=n)):
                    least_gap[a, b] = n
                    break
    best = float("inf")
    for choice in itertools.product((1, 2, 3, "merge"), repeat=len(roles)):
        state, cost = 0, 0.0
        for r, c in zip(roles, choice):
            if c == "merge":
                if state == 0 or (r and r != state):
                    cost = float("inf")
                    break
                cost += costs["merge"]
            elif (state, c) not in least_gap:
                cost = float("inf")
                break
            else:
                cost += costs["insert"] * least_gap[state, c] + (0 if c == r else costs["relabel"] if r else costs["unknown"])
                state = c
        if cost < best:
            end = 0 if state == 3 else least_gap.get((state, 3), 9) + 1
            best = min(best, cost + costs["insert"] * end)
    return best


def cost_of(roles, moves, closing, costs=chat.COSTS):
    state, cost = 0, 0.0
    for r, (action, new, inserted) in zip(roles, moves):
        for x in inserted:
            assert x in LEGAL[state]
            state = x
        cost += costs["insert"] * len(inserted)
        if action == "merge":
            assert new == state and r in (0, new)
            cost += costs["merge"]
        else:
            assert new in LEGAL[state] and (action == "keep") == (new == r)
            cost += 0 if action == "keep" else costs["relabel"] if r else costs["unknown"]
            state = new
    for x in closing:
        assert x in LEGAL[state]
        state = x
    assert state == 3
    return cost + costs["insert"] * len(closing)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_repair_is_least_cost(n):
    for roles in itertools.product(range(4), repeat=n) if n < 4 else random.Random(1).sample(list(itertools.product(range(4), repeat=n)), 40):
        moves = chat.repair(list(roles))
        closing = chat._tables(chat.COSTS)[2][moves[-1][1]]
        assert cost_of(roles, moves, closing) == brute_cost(roles)


def test_conversations_across_tasks(spark):
    """One conversation holds most turns and spans tasks; the whole is repaired as if it were one list."""
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system", "tool", None, " User"]), f"t{i}") for i in range(400)]
    rows += [(c, i, rng.choice(["user", "assistant"]), None if i % 3 else "x") for c in (1, 2, 9, None) for i in range(4)] + [(3, None, "user", "z"), (3, 0, "user", "z"), (3, 0, "user", "z"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "task", "code")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    code = {"system": 1, "user": 2, "assistant": 3}
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        order = [(r.turn is None, r.turn or 0, r.role is None, (r.role or "").encode()) for r in turns]
        assert order == sorted(order)
        whole = ""
        for r in turns:  # the rendering is what the moves say, turn by turn
            heads = "" if r.action == "merge" else ("\n" if whole else "") + "".join(f"<|{x}|>\n" + ("\n" if i < len(r.inserted_before) else "") for i, x in enumerate([*r.inserted_before, r.new_role]))
            assert r.segment.startswith("\n\n" if r.action == "merge" else heads)
            whole += r.segment
        assert whole.startswith("<|") and whole.endswith("\n<|end|>\n")
        roles = [code.get((r.role or "").strip().lower(), 0) for r in turns]
        moves = [(r.action, code[r.new_role], tuple(code[x] for x in r.inserted_before)) for r in turns]
        assert all(not r.closing for r in turns[:-1])
        best = chat.repair(roles)
        want = cost_of(roles, best, chat._tables(chat.COSTS)[2][best[-1][1]])
        assert cost_of(roles, moves, tuple(code[x] for x in turns[-1].closing)) == want
        assert sum(r.segment.count("<|end|>") for r in turns) == 1
    assert chat.format_chats(spark.createDataFrame([], df.schema)).count() == 0


def test_rendering():
    assert chat.render("keep", 2, (), (), "hi", False, False) + chat.render("merge", 2, (), (), "you", True, False) + chat.render("keep", 3, (), (), "yes", True, True) == "<|user|>\nhi\n\nyou\n<|assistant|>\nyes\n<|end|>\n"


def totals(store):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_rollups(spark, docs, odd_docs, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"))
    assert totals(store) == {}
    counted = count_words(docs)
    assert store.commit("a", upserts(counted)) and not store.commit("a", upserts(counted))
    want = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        want[r.source, r.lang, "words_1"][0] += 1
        want[r.source, r.lang, "words_1"][1] += len(r.text.split())
    assert totals(store) == {k: tuple(v) for k, v in want.items()}
    first = docs.orderBy("doc_id").first()
    key = (first.source, first.lang, "words_1")
    store.commit("b", upserts(counted.filter(F.col("doc_id") == first.doc_id).withColumn("n_tokens", F.lit(5).cast("long"))))
    want[key][1] += 5 - len(first.text.split())
    assert totals(store) == {k: tuple(v) for k, v in want.items()}
    store.commit("c", deletes(counted.filter(F.col("doc_id") == first.doc_id)))
    store.commit("d", deletes(counted.filter(F.col("doc_id") == first.doc_id)))
    want[key][0] -= 1
    want[key][1] -= 5
    assert totals(store) == {k: tuple(v) for k, v in want.items() if v[0]}
    (tmp_path / "s" / "batch=e").mkdir()  # a batch that broke off before its commit
    assert store.commit("e", upserts(counted.limit(0))) and totals(store) == {k: tuple(v) for k, v in want.items() if v[0]}


def test_rollups_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"))
    store.commit("a", clashing(upserts(count_words(odd_docs)), "d_docs"))
    ids = {r.doc_id for r in odd_docs.collect()}
    assert sum(v[0] for v in totals(store).values()) == len(ids)
    store.commit("none", upserts(count_words(no_docs)))
    assert sum(v[0] for v in totals(store).values()) == len(ids)
    got = {(r.doc_id, r.source): r.n_tokens for r in count_tokens(odd_docs).collect()}
    assert got[100, None] == 0 and got[101, "s0"] == 0 and got[105, "s2"] == 1


def test_every_row_counts(spark, odd_docs, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"))
    df = odd_docs.unionByName(odd_docs.filter("doc_id is null"))
    rows = df.collect()
    for batch in ("a", "a"):
        store.commit(batch, entries(count_words(df), df))
    assert [sum(v[i] for v in totals(store).values()) for i in (0, 1)] == [len(rows), sum(len((r.text or "").encode().split()) for r in rows)]
    store.commit("b", deletes(count_words(df.filter("doc_id = 3"))))
    assert sum(v[0] for v in totals(store).values()) == sum(r.doc_id != 3 for r in rows)


def test_revisions_and_snapshots(spark, odd_docs, tmp_path):
    """Estimates, deletions and revised counts of rows without ids, with shared ids and repeated rows; then a snapshot."""
    store = RollupStore(spark, str(tmp_path / "s"))
    df = odd_docs.unionByName(odd_docs.filter("doc_id is null"))
    rows, counted = df.collect(), count_words(df)
    whole = [len(rows), sum(len((r.text or "").encode().split()) for r in rows)]
    sums = lambda: [sum(v[i] for v in totals(store).values()) for i in (0, 1)]
    store.compact()
    store.commit("load", entries(counted.withColumn("n_tokens", F.lit(7).cast("long")), df))
    assert sums() == [len(rows), 7 * len(rows)]
    store.commit("gone", deletes(counted.filter("n_tokens = 0")))
    empty = {r.doc_id for r in rows if not (r.text or "").split()}
    assert sums()[0] == sum(r.doc_id not in empty for r in rows)
    for batch in ("count", "count"):
        store.commit(batch, revisions(counted, df))
        assert sums() == whole
    before = totals(store)
    store.compact()
    assert totals(store) == before and not store.commit("count", revisions(counted, df))
    store.commit("out", deletes(counted.filter("doc_id = 3")))
    store.compact()
    assert sums()[0] == sum(r.doc_id != 3 for r in rows)
    log = store.log().collect()
    assert len(log) == len({(r.doc_id, r.source, r.lang) for r in log}) and all(r.d_docs > 0 for r in log)


def test_query_counts_every_row(spark, sf_dir):
    from quantloom.llm.catalog import QUERIES
    from quantloom.llm.tokens import rank_encoder

    encoder, want = rank_encoder(None), defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for version, n in (("words_1", len((r.text or "").encode().split())), ("byte_bpe_50k", len(encoder.encode_ordinary(r.text or "")))):
            want[r.source, r.lang, version][0] += 1
            want[r.source, r.lang, version][1] += n
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    assert got == dict(want)
