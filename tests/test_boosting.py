"""Boosted trees against a plain reference, and their dropped form."""

import numpy as np
import pytest

from oddgraph.operators import boosting as B


def table(spark, rng, n=400, width=3):
    x = np.round(rng.standard_normal((n, width)), 1)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (rng.random(n) < 0.05)).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]) if i % 10 else None) for i in range(n)]
    return x, np.array([-1 if r[2] is None else r[2] for r in rows]), spark.createDataFrame(rows, "id long, f array<double>, y int")


def plain(bins, y, s, cuts, subset):
    """Margins of boosted trees without dropping, each grown by looking at every cut of every row."""
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    margin = np.zeros(len(y))
    for t in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y) * subset(t), w * p * (1 - p) * subset(t)

        def grow(rows, depth):
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-9, None, None)
            for j in range(bins.shape[1]) if depth < s.depth else ():
                for c in range(cuts):
                    left, right = rows[bins[rows, j] <= c], rows[bins[rows, j] > c]
                    hl, hr = h[left].sum(), h[right].sum()
                    if hl >= s.least and hr >= s.least:
                        gain = g[left].sum() ** 2 / (hl + s.shrink) + g[right].sum() ** 2 / (hr + s.shrink) - G**2 / (H + s.shrink)
                        if gain > best[0] + 1e-12:
                            best = (gain, left, right)
            if best[1] is None:
                step[rows] = -G / (H + s.shrink)
            else:
                grow(best[1], depth + 1), grow(best[2], depth + 1)

        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        margin = margin + s.rate * step
    return margin


def test_without_drops_it_is_plain_boosting(spark):
    x, y, nodes = table(spark, np.random.default_rng(5))
    s = B.Settings(trees=4, rate=0.3, depth=3, shrink=1.0, share=0.7)
    forest = B.train(nodes.repartition(3), 3, s, seed=2, bins=8)
    bins, known = forest.binned(x), np.flatnonzero(y >= 0)
    subset = lambda t: (B._uniform(known, 2, t) < s.share).astype(float)
    want = plain(bins[known], y[known], s, max(map(len, forest.cuts)), subset)
    assert np.allclose(forest.margins(bins)[known], want)
    got = {r["id"]: r["score"] for r in B.scores(nodes, forest).collect()}
    assert np.allclose([got[i] for i in known], 1 / (1 + np.exp(-want))) and len(got) == 400
    assert forest.losses == sorted(forest.losses, reverse=True) and forest.weights == [0.3] * 4


def test_dropped_trees_are_rescaled(spark):
    x, y, nodes = table(spark, np.random.default_rng(6))
    s = B.Settings(trees=12, rate=0.3, depth=2, shrink=1.0, drop=0.4)
    forest, again = (B.train(nodes.repartition(k), 3, s, seed=4, bins=8) for k in (2, 5))
    assert np.allclose(forest.margins(forest.binned(x)), again.margins(again.binned(x)))
    rng, weights = np.random.default_rng(4), []
    for t in range(s.trees):
        rng.random()
        dropped = [k for k in range(t) if rng.random() < s.drop]
        for k in dropped:
            weights[k] *= len(dropped) / (len(dropped) + s.rate)
        weights.append(s.rate / (len(dropped) + s.rate) if dropped else s.rate)
    assert np.allclose(forest.weights, weights) and min(weights) < s.rate
    known = y >= 0
    p = 1 / (1 + np.exp(-forest.margins(forest.binned(x))))
    assert p[known & (y == 1)].mean() > p[known & (y == 0)].mean() + 0.1
    # What the margins kept with the blocks add up to is what the loss of a last tree is measured on.
    skipped = B.train(nodes, 3, B.Settings(trees=5, rate=0.3, depth=2, drop=0.9, skip=1.0), bins=8)
    assert skipped.weights == [0.3] * 5


def test_one_class_raises(spark):
    _, _, nodes = table(spark, np.random.default_rng(7))
    with pytest.raises(ValueError, match="normal and anomalous"):
        B.train(nodes.where("y = 0"), 3)
