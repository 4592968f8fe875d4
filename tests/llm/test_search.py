"""Searches over embeddings against every pair of rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from sparkaudit.llm import cover_tree, gnat, vectors

ROWS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in ("cell", "part", "block", "score", "rank", "body", "n")]])
ANCHOR = "vec_id % 5 = 0"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], ROWS)


def clustered(seed=1, n=260, width=6):
    """Clusters, one vector that a third of all rows share, ties, repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    rows = [(i, [float(x) for x in centres[i % 7] + 0.2 * rng.normal(size=width)], int(rng.integers(4))) for i in range(n)]
    rows += [(1000 + i, [0.5] * width, i % 3) for i in range(n // 2)]
    rows += [(2000 + i, [float(x) for x in rng.integers(-1, 2, size=width)], i % 2) for i in range(60)]  # many ties
    rows += [(2500, [1.0, 2.0], 1), (2505, [1.0] * 9, 1), (2510, [], 2), (2515, [0.0] * width, 2)]
    rows += [(2520, None, 1), (2525, [1.0, None], 1), (2530, [math.nan] * width, 1), (2535, [math.inf] * width, 1),
             (None, [1.0] * width, 1), (2540, [1.0] * width, None), (2545, [3e38] * width, 1)]
    rows += [rows[5], rows[5], rows[300]]
    random.Random(seed).shuffle(rows)
    return rows


def taking_part(rows, labelled):
    out = {}
    for i, v, label in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if sum(x * x for x in q) < 2**62:
            out[i, q, label] = None
    return list(out)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, k):
    rows = taking_part(rows, False)
    out = []
    for i, q, _ in rows:
        if i % 5 == 0:
            best = sorted((-dot(q, v), j) for j, v, _ in rows if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows):
    rows = taking_part(rows, True)
    out = []
    for i, q, label in rows:
        if i % 5 == 0:
            for s, p in sorted((-dot(q, v), j) for j, v, y in rows if j != i and y == label)[:5]:
                bad = sorted((-dot(q, v), j) for j, v, y in rows if y != label and -50 * s <= 100 * dot(q, v) <= -95 * s)[:3]
                out += [(i, p, n + 1, j, -s, -t) for n, (t, j) in enumerate(bad)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(30, 9, 4), (vectors.BLOCK_ROWS, vectors.GROUP_ROWS, 16)])
def test_top_k_against_all_pairs(spark, sizes):
    rows = clustered()
    got = cover_tree.top_k(frame(spark, rows).repartition(3), F.expr(ANCHOR), 5, *sizes)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)


@pytest.mark.parametrize("sizes", [(30, 9, 4), (vectors.BLOCK_ROWS, vectors.GROUP_ROWS, 16)])
def test_hard_negatives_against_all_pairs(spark, sizes):
    rows = clustered(2)
    got = gnat.hard_negatives(frame(spark, rows).repartition(3), F.expr(ANCHOR), block_rows=sizes[0], group_rows=sizes[1], leaf=sizes[2])
    want = brute_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_empty_and_too_few(spark):
    assert cover_tree.top_k(frame(spark, []), F.expr(ANCHOR)).count() == 0
    assert gnat.hard_negatives(frame(spark, []), F.expr(ANCHOR)).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 2)]
    assert [tuple(r) for r in cover_tree.top_k(frame(spark, few), F.expr(ANCHOR)).collect()] == [(0, 1, 1, 256 * 128)]
    assert gnat.hard_negatives(frame(spark, few), F.expr(ANCHOR)).count() == 0  # no positive


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**21 - i), float(i % 3)], 0) for i in range(40)]  # products beyond 2^53
    assert max(s for *_, s in brute_top(rows, 3)) > 2**53
    got = cover_tree.top_k(frame(spark, rows), F.expr(ANCHOR), 3, 10, 4, 4)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 3)


def test_cover_tree_covers_nests_and_separates():
    x = np.floor(np.random.default_rng(0).normal(size=(900, 5)) * 100)
    t = cover_tree.cover_tree(x, leaf=10)
    p = x[t["order"]]
    for a, b, r, child, kids in zip(t["first"], t["last"], t["radius"], t["child"], t["kids"], strict=True):
        assert (vectors.distances(p[a:b], p[a][None]) <= r + 1e-6).all()
        if kids:
            first = t["first"][child:child + kids]
            assert first[0] == a and t["last"][child + kids - 1] == b and (first[1:] == t["last"][child:child + kids - 1]).all()
            centres = p[first]
            apart = vectors.distances(centres, centres)[np.triu_indices(kids, 1)]
            assert apart.min() >= vectors.distances(p[a:b], centres).min(1).max() - 1e-6
    # near queries leave most pairs of nodes out, none that matters
    body = {**t, "vecs": p.astype(np.int32), "ids": np.arange(900), "twin": np.zeros(900, int)}
    scores, _ = cover_tree.dual_search(body, body, np.full(900, vectors.NOTHING), 3)
    full = p @ p.T
    np.fill_diagonal(full, -np.inf)
    assert (scores == -np.sort(-full, axis=1)[:, :3]).all()


def test_gnat_ranges_hold_and_eliminate():
    rng = np.random.default_rng(1)
    x = np.floor(np.concatenate([c + rng.normal(size=(200, 4)) * 5 for c in rng.normal(size=(6, 4)) * 400]))
    t = gnat.gnat(x, leaf=20)
    p = x[t["order"]]
    for node, (_, _, child, kids) in enumerate(t["nodes"]):
        for j in range(kids):
            a, b = t["nodes"][child + j][:2]
            away = vectors.distances(p[t["splits"][node]], p[a:b])
            assert (np.abs(away.min(1) - t["low"][node][:, j]) < 1e-6).all() and (np.abs(away.max(1) - t["high"][node][:, j]) < 1e-6).all()
    q = p[:5]
    best = np.sort(q @ p.T, axis=1)[:, -4:-3].astype(np.int64)
    hit = gnat.meets(vectors.distances(q, p[t["splits"][0]]), t["low"][0], t["high"][0], t["lengths"][0], (q**2).sum(1), best,
                     np.full_like(best, gnat.NO_END))
    assert hit.any(1).all() and not hit.all()  # siblings are eliminated


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_exact_top_k"])
def test_queries_find_something(spark, sf_small, name):
    assert E.queries()[name](spark, sf_small).count() > 0
