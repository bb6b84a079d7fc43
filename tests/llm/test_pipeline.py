import pytest

import corpus_pipeline
from quantloom.llm.common import materialise

from .conftest import clashing
from .test_joins import brute_join
from .test_lines_and_mix import brute_lines


def test_stages(spark, sf_dir, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "n-gram Jaccard join", "source mixing", "best-fit packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, at, sf_dir))
        assert out.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in at.collect()]
        if name == "line dedup":
            assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((i, t) for i, _, _, t in brute_lines(rows))
        if name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in brute_join(rows, 5, 80) if i == c)
        at = out
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
    assert packed.filter("piece = 0").count() == at.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


@pytest.mark.parametrize("which", ["odd_docs", "no_docs", "clashing"])
def test_stages_on_odd_tables(spark, odd_docs, no_docs, which):
    """Every stage stands nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""
    names = ("_id", "_hash", "_drop", "_rate", "_copy", "cls", "score", "size", "piece", "length")
    at = {"odd_docs": odd_docs, "no_docs": no_docs, "clashing": clashing(odd_docs, *names)}[which]
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.collect()
        at = materialise(stage(spark, at, ""))
        rows = at.collect()
        assert at.columns == columns
        if name == "language ID":
            assert not any(r.text is None or not any(map(str.isalpha, r.text)) for r in rows)
        if name == "line dedup":
            assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in before])), key=str)
        if name == "n-gram Jaccard join":
            assert sum(r.doc_id is None for r in rows) == sum(r.doc_id is None for r in before)
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before}
        if name == "source mixing":
            assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in before}
    packed = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    assert sum(r.piece == 0 for r in packed) == at.count()
    if which == "no_docs":
        assert packed == []
