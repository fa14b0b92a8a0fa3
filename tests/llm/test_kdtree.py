import random

import numpy as np
import pytest

from tablelens.llm.kdtree import Tree, quantised, top_products


def brute(points, queries, k):
    found = {}
    for qid, q in queries:
        scored = sorted((-(int(np.dot(q, p))), vid) for vid, p in points if vid != qid)[:k]
        found[qid] = [(-s, v) for s, v in scored]
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_search_is_exact_with_ties(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 4, (700, 3)).astype(float)
    tree = Tree(points, np.arange(700), leaf=8)
    for own in range(0, 700, 50):
        expected = brute(list(enumerate(points)), [(own, points[own])], 7)[own]
        assert [(int(s), i) for s, i in tree.search(points[own], own, 7, -np.inf)] == expected
        worst = expected[-1][0]
        assert [(int(s), i) for s, i in tree.search(points[own], own, 7, worst)] == expected


def test_boxes_are_tight_and_leaves_small():
    points = np.random.default_rng(3).normal(size=(1000, 4))
    tree = Tree(points, np.arange(1000), leaf=16)
    for node, (begin, end) in enumerate(tree.spans):
        assert (tree.points[begin:end].min(0) == tree.low[node]).all() and (tree.points[begin:end].max(0) == tree.high[node]).all()
        assert tree.children[node][0] >= 0 or end - begin <= 16


@pytest.mark.parametrize("shard_rows", [40, 100_000])
def test_search_over_shards_equals_brute_force(frame, shard_rows):
    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(600)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)]  # a vector that repeats
    rows += [(2000, None), (2001, []), (2050, [float("nan")] * 6), (2051, [None] * 6), (2052, [float("inf")] * 6), (None, [1.0] * 6)]
    points = quantised(frame(rows, "vec_id long, embedding array<float>"))
    queries = points.where("vec_id % 50 = 0")
    exact = [(i, [np.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows[:900]]
    expected = brute(exact, [(i, v) for i, v in exact if i % 50 == 0], 5)
    got = {}
    for row in top_products(points, queries, 5, shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.score, row.vec_id))
        assert row.rank == len(got[row.query_id])
    assert got == expected


def test_few_repeated_and_short_vectors(frame):
    table = frame([(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "a"), (7, [3.0], "b"), (7, [3.0], "b")], "vec_id long, embedding array<double>, score string")
    points = quantised(table)
    rows = top_products(points, points.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [(0, 1, 7, 256 * 768), (0, 2, 7, 256 * 768)]
    assert top_products(points.limit(0), points, 5).count() == 0
    assert top_products(points, points.limit(0), 5).count() == 0


def test_large_integers_stay_exact(frame):
    table = frame([(0, [2.0**30, 1.0]), (1, [2.0**21, 3.0]), (2, [2.0**21, 4.0])], "vec_id long, embedding array<double>")
    points = quantised(table, scale=1.0)
    rows = top_products(points, points.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 2**51 + 4), (1, 2**51 + 3)]
