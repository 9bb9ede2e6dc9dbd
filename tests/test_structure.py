"""Iterated structure and exact negatives against brute force on small graphs."""

import os

import numpy as np
import pytest

from oddgraph.operators import edges as G
from oddgraph.operators import neighbours as N
from oddgraph.operators import sampling as S
from oddgraph.operators import structure as T
from tests.test_graph import edges, nodes


def graph(spark, a):
    """An undirected edge table and the nodes of a symmetric 0/1 matrix."""
    rows = [(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))]
    ids = spark.createDataFrame([(i,) for i in range(len(a))], "id long")
    return edges(spark, rows or [(0, 0, 0.0)]).where("src <> dst"), ids


def peeled(a):
    """Core numbers by peeling."""
    core = np.zeros(len(a), int)
    for k in range(1, len(a)):
        live = np.ones(len(a), bool)
        while (gone := live & (a[:, live].sum(1) < k)).any():
            live &= ~gone
        core[live] = k
    return core.tolist()


def symmetric(rng, n, p):
    up = np.triu(rng.random((n, n)) < p, 1)
    return (up | up.T).astype(int)


def test_core_numbers_against_peeling(spark):
    rng = np.random.default_rng(3)
    path = np.diag(np.ones(11, int), 1)
    ring = path + np.eye(12, k=11, dtype=int)
    clique_with_tail = np.zeros((9, 9), int)
    clique_with_tail[:5, :5] = 1 - np.eye(5, dtype=int)
    for i in range(4, 8):
        clique_with_tail[i, i + 1] = clique_with_tail[i + 1, i] = 1
    star = np.zeros((30, 30), int)
    star[0, 1:] = star[1:, 0] = 1
    cases = [path + path.T, ring + ring.T, clique_with_tail, star, np.zeros((3, 3), int)] + [symmetric(rng, n, p) for n, p in ((10, 0.3), (14, 0.5), (25, 0.2), (8, 1.0))]
    for a in cases:
        got = dict(map(tuple, T.core_numbers(*graph(spark, a)).collect()))
        assert [got[i] for i in range(len(a))] == peeled(a)


def test_fingerprint_of_a_triangle_with_a_tail_and_an_isolated_node(spark):
    a = np.zeros((5, 5), int)
    for i, j in ((0, 1), (0, 2), (1, 2), (2, 3)):
        a[i, j] = a[j, i] = 1
    e, ids = graph(spark, a)
    names = ["degree", "clustering", "core"]
    local = N.clustering(e, ids).join(T.core_share(T.core_numbers(e, ids)), "id")
    got = {r["id"]: r for r in N.structural_fingerprint(local, e, names).collect()}
    want = np.array([[2 / 3, 2 / 3, 1, 1 / 3, 0], [1, 1, 1 / 3, 0, 0], [1, 1, 1, 0.5, 0]]).T
    assert np.allclose([[got[i][n] for n in names] for i in range(5)], want)
    pooled = [[got[i][f"pooled_{n}"] for n in names] for i in range(5)]
    assert np.allclose(pooled[0], (want[1] + want[2]) / 2) and np.allclose(pooled[3], want[2]) and pooled[4] == [0, 0, 0]


def test_pagerank_to_tolerance(spark):
    rng = np.random.default_rng(8)
    a = (rng.random((12, 12)) < 0.2).astype(float)
    a[4] = 0  # dangling
    e = G.binary(edges(spark, [(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))]))
    ids = spark.createDataFrame([(i,) for i in range(12)], "id long")
    out = a.sum(1, keepdims=True)
    m = np.where(out > 0, a / np.where(out > 0, out, 1), 1 / 12)
    p, rounds = np.full(12, 1 / 12), 0
    while True:
        new, rounds = 0.15 / 12 + 0.85 * (m.T @ p), rounds + 1
        change, p = np.abs(new - p).sum(), new
        if change < 12 * 1e-8:
            break
    got = {r["id"]: (r["p"], r["rounds"]) for r in T.pagerank_to(e, ids, 1e-8).collect()}
    assert np.allclose([got[i][0] for i in range(12)], p, atol=1e-12) and got[0][1] == rounds
    assert T.pagerank_to(e, ids, 1e-12, most=3).first()["rounds"] == 3
    assert np.allclose(sum(np.exp(r["p"]) for r in T.pagerank_to(e, ids, log=True).collect()), 1)
    assert T.pagerank_to(e.where("false"), ids.where("false")).count() == 0


@pytest.mark.parametrize("n", [7, 40])
def test_non_neighbours_are_all_there(spark, n):
    """Nodes next to nothing, to a few, to all but some and to all others: always min(k, available) distinct rows."""
    rows = [(0, j, 1.0) for j in range(n) if j not in (3, 5)] + [(1, j, 1.0) for j in range(n)] + [(2, 2, 1.0), (2, 0, 1.0), (2, 0, 1.0)] + [(3, j, 1.0) for j in range(0, n, 2)]
    e, ids = edges(spark, rows), spark.createDataFrame([(i,) for i in range(n)], "id long").repartition(3)
    near = {i: {i} | {b for a, b, _ in rows if a == i} for i in range(n)}
    for k in (1, 4, n):
        got: dict = {}
        for r in S.non_neighbours(e, ids, k, 7).collect():
            got.setdefault(r["id"], {})[r["slot"]] = r["cand"]
        for i in range(n):
            found = got.get(i, {})
            assert sorted(found) == list(range(1, min(k, n - len(near[i])) + 1))
            assert len(set(found.values())) == len(found) and not set(found.values()) & near[i]
    few = {(r["id"], r["slot"]): r["cand"] for r in S.non_neighbours(e, ids, 2, 7).collect()}
    many = {(r["id"], r["slot"]): r["cand"] for r in S.non_neighbours(e, ids, 5, 7).collect()}
    assert all(many[x] == c for x, c in few.items())


def test_triplets(spark):
    n = 9
    e = edges(spark, [(i, (i + 1) % n, 1.0) for i in range(n)] + [(i, i, 3.0) for i in range(n)] + [(0, 5, 1.0)])
    ids = nodes(spark, [[0.0]] * n).select("id")
    got = S.triplets(e, ids, 100, 4, 4).collect()
    assert sorted({(r["anchor"], r["positive"]) for r in got}) == sorted([(i, (i + 1) % n) for i in range(n)] + [(0, 5)])
    for a, p in {(r["anchor"], r["positive"]) for r in got}:
        mine = [r["negative"] for r in got if (r["anchor"], r["positive"]) == (a, p)]
        assert len(set(mine)) == 4 and not set(mine) & {a, (a + 1) % n, *([5] if a == 0 else [])}
    assert {tuple(r) for r in S.triplets(e.repartition(5), ids, 3, 4, 4).collect()} <= {tuple(r) for r in got}
    full = edges(spark, [(i, j, 1.0) for i in range(5) for j in range(5)])
    with pytest.raises(ValueError, match="non-neighbours"):
        S.triplets(full, ids.where("id < 5"), 10, 1, 0)
    assert S.triplets(full, ids.where("id < 5"), 10, 1, 0, strict=False).count() == 0


def test_core_numbers_over_blocks_leave_one_state(spark, monkeypatch):
    """Several blocks give what peeling gives, and of the rounds' files only the last are left."""
    a = symmetric(np.random.default_rng(5), 30, 0.2)
    made, cut = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df: made.append(cut(df)) or made[-1])
    monkeypatch.setattr(T.B, "blocks", lambda n: 5)
    monkeypatch.setattr(T, "ROUNDS", 1)
    got = dict(map(tuple, T.core_numbers(*graph(spark, a)).collect()))
    assert [got[i] for i in range(30)] == peeled(a)
    left = [os.path.exists(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")) for df in made]
    assert len(left) > 1 and not any(left[:-1]) and left[-1]
