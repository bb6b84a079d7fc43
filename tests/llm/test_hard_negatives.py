import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm.catalog import QUERIES
from quantloom.llm.hard_negatives import Bucket, integer_rows, mine

from .conftest import clashing

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) and abs(256 * x) <= 1 << 27 for x in v)
    rows = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and sound(v)]
    out = []
    for a, lab, q in sorted({(i, lab, tuple(v)) for i, lab, v in rows if i % every == 0}):
        scored = [(-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in rows if i != a and len(v) == len(q)]
        for s, p, _ in sorted(r for r in scored if r[2] == lab)[:positives]:
            good = sorted((t, n) for t, n, other in scored if other != lab and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(good)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def around(rng, n, width=12, labels=4, spread=0.4):
    """Vectors around centres, of many lengths, with labels that do not always follow the centre."""
    centers = rng.normal(size=(labels, width))
    at = rng.integers(0, labels, n)
    x = (centers[at] + spread * rng.normal(size=(n, width))) * rng.uniform(0.2, 2, (n, 1))
    label = np.where(rng.random(n) < 0.2, rng.integers(0, labels, n), at)
    return [(int(i), [float(np.float32(v)) for v in row], int(lab)) for i, (row, lab) in enumerate(zip(x, label))]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = around(np.random.default_rng(3), 150)
    rows += [(1000 + i, rows[0][1], rows[0][2] + i % 2) for i in range(20)]  # copies: ties
    rows += [(1050, [0.0] * 12, 1), (1051, [0.0] * 12, 1), (1052, [0.0] * 12, 2), (1100, [-1.0] * 12, 1), (1150, [2.0, 1.0], 1), (1151, [2.0, 1.0], 1), (1152, [1.0, 1.0], 2), (1200, [], 1), (1201, [], 1), (1202, [], 2)]
    rows += [(None, rows[1][1], 1), (1250, None, 1), (1251, rows[2][1], None), (1252, [None, *rows[2][1][1:]], 1), (1253, [math.nan] * 12, 1), (1254, [math.inf] * 12, 1), (1300, [1e30] * 12, 1)]
    rows += [(1350, [400_000.5 + rng.random() for _ in range(12)], 3), (1351, [400_000.5 + rng.random() for _ in range(12)], 3), (1352, [300_000.0] * 12, 2)]
    rows += [rows[50], rows[50], rows[7], (100, [x + 1 for x in rows[100][1]], 0)]  # repeated rows; an id taken twice
    return spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize("focus", [1, 4, 100])
def test_odd_rows_are_brute_force(odd, focus):
    rows = [(r.vec_id, r.embedding, r.label) for r in odd.collect()]
    want = brute(rows)
    assert got(mine(integer_rows(odd), focus=focus)) == want and len(want) > 20


def test_few_seeds_and_other_numbers(odd):
    rows = [(r.vec_id, r.embedding, r.label) for r in odd.collect()]
    assert got(mine(integer_rows(odd), every=7, positives=2, negatives=6, seed_rows=3)) == brute(rows, 7, 2, 6)


def test_many_buckets(spark):
    rows = around(np.random.default_rng(4), 2500, width=16, labels=6, spread=0.7)
    df = spark.createDataFrame(rows, VECTORS)
    assert got(mine(integer_rows(df))) == brute(rows)


def test_query_on_its_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(QUERIES["op11_hard_negative_mining"](spark, sf_dir)) == brute(rows)


def test_empty_and_clashing(spark, odd):
    assert mine(integer_rows(spark.createDataFrame([], VECTORS))).collect() == []
    assert mine(integer_rows(odd.filter("vec_id % 50 <> 0"))).collect() == []
    assert got(mine(integer_rows(clashing(odd, "id", "v", "key", "bucket", "length", "rank")))) == got(mine(integer_rows(odd)))
    assert integer_rows(odd).columns == ["id", "label", "v"] and integer_rows(odd).filter(F.col("id") == 1300).count() == 0


def test_candidates_are_a_superset_and_fewer():
    rng = np.random.default_rng(8)
    x = np.round(256 * (rng.normal(size=(5, 24))[rng.integers(0, 5, 600)] + 0.2 * rng.normal(size=(600, 24))))
    bucket, share = Bucket(np.arange(600), np.zeros(600, int), x), []
    for q in x[:60]:
        scores = x @ q
        for reach in np.quantile(scores, [0.95, 0.99, 0.999]):
            found = bucket.candidates(q, reach, 8)
            true = set(np.flatnonzero(scores >= reach).tolist())
            assert found is None and reach <= 0 or true <= set(found.tolist())
            share.append(1.0 if found is None else len(found) / 600)
    assert np.mean(share) < 0.6
    assert len(bucket.candidates(x[0], 1e12, 4)) == 0
