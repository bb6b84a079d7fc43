import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm.packing import SIZE, best_fit_pack, plan
from quantloom.llm.tokens import word_encoder

from .conftest import clashing


def reference(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_tokenizers(text):
    got = np.frombuffer(word_encoder().encode_batch([text])[0], "<u4").tolist()
    assert got == reference(text)[:-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbBéÉñs'tldmrv09_-.,!&#$% \t\n\x0bßŒž€–’", max_size=80))
def test_ids_of_plain_texts(text):
    assert np.frombuffer(word_encoder().encode_batch([text])[0], "<u4").tolist() == reference(text)[:-1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, SIZE), min_size=1, max_size=400))
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=SIZE + 1)
    runs = plan(counts)
    placed, spans = np.zeros(SIZE + 1, int), defaultdict(list)
    for length, first, repeats, sequence, offset in runs.tolist():
        assert first == placed[length]
        placed[length] += repeats
        for r in range(repeats):
            spans[sequence + r].append((offset, length))
    assert (placed == counts).all()
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= SIZE


def test_few_sequences():
    lengths = np.clip(np.random.default_rng(0).lognormal(6.6, 0.9, 50_000).astype(int), 1, SIZE)
    runs = plan(np.bincount(lengths, minlength=SIZE + 1))
    assert (runs[:, 3] + runs[:, 2]).max() <= -(-lengths.sum() // SIZE) * 1.005


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "docs"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    rows = best_fit_pack(clashing(df, "_rank", "length", "_bucket"), with_ids=True).collect()
    want = []
    for r in df.collect():
        ids = reference(r.text)
        for p in range(0, len(ids), SIZE):
            part = ids[p : p + SIZE]
            want.append((r.doc_id, p // SIZE, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    spans = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= SIZE
    if rows:
        assert len(spans) <= -(-sum(r.length for r in rows) // SIZE) * 1.05 + 1
