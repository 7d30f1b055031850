"""Operator 12 against all products."""

import math

import numpy as np
import pytest

from loomrec.llm import topk
from loomrec.llm.common import ship

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, v string, dim string, least string"


def plain(rows, every, k, scale=topk.SCALE):
    own = {}
    for i, e in rows:
        if i is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        e = [float(np.float32(x)) for x in e]
        own[i] = min(own.get(i, e), e)
    own = {i: [math.floor(scale * x) for x in e] for i, e in own.items() if sum((abs(scale * x) + 1) ** 2 for x in e) <= topk.LARGEST}
    out = []
    for i, q in own.items():
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for j, e in own.items() if j != i and len(e) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def got(spark, rows, **kw):
    ship(spark)
    df = spark.createDataFrame([(i, e, 0, 1, 1.0, "a", "b", "c") for i, e in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, topk.top_products(df, **kw).collect()))


def test_products_of_any_vectors(spark):
    """Lengths of many sizes, zero and equal vectors, ties, other widths, numbers that aren't finite, very long ones, repeated ids."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) * rng.lognormal(sigma=1.5, size=(500, 1))
    x[50:90] = x[50]
    x[90:95] = 0
    rows = [(int(i), e.tolist()) for i, e in enumerate(x)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(12)]
    rows += [(2000, None), (2020, []), (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (None, [9.0] * 6)]
    rows += [(2100, [3e38] * 6), (2120, [2e7] * 6), (2121, [1e7, -1e7, 0.0, 0.0, 0.0, 3.0]), (40, [0.0] * 6), (40, x[40].tolist()), (-20, [1.0] * 6)]
    rows += [(3000, [1.0, 2.0])]  # alone in its width
    assert got(spark, rows, every=20, k=7, shelf_rows=60, block_rows=9) == plain(rows, 20, 7)


def test_few_vectors(spark):
    assert got(spark, [(0, [1.0, 2.0])]) == [] and got(spark, []) == []
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    assert got(spark, rows) == plain(rows, 20, 20)


@pytest.mark.parametrize(("spread", "sigma"), [(0.02, 0.01), (0.3, 0.5), (3.0, 0.1)])
def test_buckets_prune_by_coordinates_and_by_length(monkeypatch, spread, sigma):
    """Clusters, tight ones and loose ones: a block of queries finds what all products give, bucket by bucket."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(20, size=2000)] + spread * rng.normal(size=(2000, 16))
    x = np.floor(64 * x * rng.lognormal(sigma=sigma, size=(2000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids = rng.permutation(2000)
    order = np.lexsort((ids, -(x**2).sum(1)))
    x, ids = x[order], ids[order]
    asked = np.flatnonzero(ids % 20 == 0)
    seen = []
    plain_products = topk.products
    monkeypatch.setattr(topk, "products", lambda a, b, bound: (seen.append((len(a), len(b))), plain_products(a, b, bound))[1])
    real = x[asked].astype(float)
    best = topk.Best(len(asked), 10, np.full(len(asked), -np.inf))
    for a in range(0, 2000, 128):
        topk.visit(topk.Bucket(ids[a : a + 128], x[a : a + 128]), ids[asked], real, np.sqrt((real**2).sum(1)), best)
    for r, i in enumerate(asked):
        scores = x @ x[i]
        want = [j for j in np.lexsort((ids, -scores)) if j != i][:10]
        assert best.score[r].tolist() == scores[want].tolist() and best.ids[r].tolist() == ids[want].tolist()
    compared = sum(a * b for a, b in seen)
    assert compared <= (0.3 if spread < 1 else 1) * len(asked) * 2000


def test_products_beyond_doubles():
    a = np.array([[2**30, 3, -1]], np.int64)
    b = np.array([[2**30, 1, 1], [2**30, 1, 2]], np.int64)
    assert topk.products(a, b, float(2**62)).tolist() == [[2**60 + 2, 2**60 + 1]]
