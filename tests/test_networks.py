"""Trained networks against dense references, numeric gradients and their own split forms."""

import numpy as np
import pytest

from oddgraph.operators import networks as W


def graph(spark, rng, n=14, width=3):
    """Random edges with loops, a node of in-edges from all others and one without any but its loop."""
    a = rng.random((n, n)) < 0.2
    a[:, 2] = True
    a[:, 5] = False
    a |= np.eye(n, dtype=bool)
    x, y = rng.standard_normal((n, width)), [int(v) for v in rng.random(n) < 0.4]
    y[0], y[1] = 0, 1
    labels = [None if i % 5 == 4 else y[i] for i in range(n)]
    w = rng.random((n, n)) * a
    e = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(a))], "src long, dst long, w double").repartition(3)
    f = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, f array<double>")
    nodes = spark.createDataFrame(list(enumerate(labels)), "id long, y int")
    return a, w, x, np.array([-1 if v is None else v for v in labels]), e, f, nodes


def mean_loss(z, y):
    positive = (y == 0).sum() / (y == 1).sum()
    return W.weighted_loss(z, y, positive)[0] / (2 * (y == 0).sum())


def leaky(x):
    return np.where(x > 0, x, 0.2 * x)


def dense_attention(a, x, p, heads, hidden):
    """Both layers over the whole matrix a[src, dst]."""

    def layer(h, s, d, k):
        logits = leaky(np.einsum("nkd,kd->nk", h, s)[:, None] + np.einsum("nkd,kd->nk", h, d)[None])  # src, dst, head
        logits = np.where(a[:, :, None], logits, -np.inf)
        share = np.exp(logits - logits.max(axis=0))
        share /= share.sum(axis=0)
        return np.einsum("sdk,skf->dkf", share, h)

    h = np.maximum(layer((x @ p["w0"]).reshape(len(x), heads, hidden), p["s0"], p["d0"], heads).reshape(len(x), -1) + p["b0"], 0)
    return layer((h @ p["w1"])[:, None], p["s1"], p["d1"], 1)[:, 0] + p["b1"]


def numeric(loss, params, step=1e-6):
    out = {}
    for k, p in params.items():
        g = np.zeros_like(p)
        for i in np.ndindex(p.shape):
            moved = {n: v.copy() for n, v in params.items()}
            moved[k][i] += step
            up = loss(moved)
            moved[k][i] -= 2 * step
            g[i] = (up - loss(moved)) / (2 * step)
        out[k] = g
    return out


def close(a, b):
    return all(np.allclose(a[k], b[k], atol=1e-6) for k in b)


def scores(df):
    got = {r["id"]: r["score"] for r in df.collect()}
    return [got[i] for i in range(len(got))]


def test_perceptron(spark):
    rng = np.random.default_rng(1)
    _, _, x, y, _, f, nodes = graph(spark, rng)
    net = W.Perceptron(hidden=4)
    params = net.first(3, 5)

    def dense(p, x=x):
        for k in range(2):
            z = x @ p[f"w{k}"] + p[f"b{k}"]
            x = np.where(z > 0, z, 0.01 * z)
        return x @ p["w2"] + p["b2"]

    blocks = W.node_blocks(f.join(nodes, "id").repartition(3), 3, size=4)
    loss, grads = net.loss_and_gradient(blocks, params)
    assert np.isclose(loss, mean_loss(dense(params), y)) and close(numeric(lambda p: mean_loss(dense(p), y), params), grads)
    trained, want, step = net.train(blocks, 3, 6, 0.05, 0.01, seed=5), params, W.Adam(0.05, 0.01)
    for _ in range(6):
        want = step(want, numeric(lambda p: mean_loss(dense(p), y), want))
    assert all(np.allclose(want[k], trained.params[k], atol=1e-4) for k in want) and trained.losses[-1] < trained.losses[0]
    assert np.allclose(scores(net.scores(blocks, params)), W.softmax(dense(params))[:, 1])
    with pytest.raises(ValueError, match="normal and anomalous"):
        net.train(W.node_blocks(f.join(nodes.where("y = 0"), "id"), 3), 3, 1, 0.1)


@pytest.mark.parametrize(("hub", "size"), [(1 << 16, 4096), (3, 2)])
def test_convolution(spark, hub, size):
    """Also with split targets: the node of many in-edges lies in several blocks."""
    rng = np.random.default_rng(2)
    a, w, x, y, e, f, nodes = graph(spark, rng)
    net = W.Convolution(hidden=4)
    params = net.first(3, 7) | {"b0": rng.standard_normal(4) * 0.1}
    dense = lambda p: w.T @ np.maximum(x @ p["w0"] + p["b0"], 0) @ p["w1"] + p["b1"]
    blocks = W.convolution_blocks(e, f, nodes, 3, hub, size)
    assert (blocks.split is not None) == (hub == 3)
    loss, grads = net.loss_and_gradient(blocks, params)
    assert np.isclose(loss, mean_loss(dense(params), y)) and close(numeric(lambda p: mean_loss(dense(p), y), params), grads)
    assert np.allclose(scores(net.scores(blocks, params)), W.softmax(dense(params))[:, 1])
    trained = net.train(blocks, 3, 8, 0.1)
    assert trained.losses[-1] < trained.losses[0]


def test_dropout_is_the_same_in_every_block(spark):
    ids = np.arange(3000)
    m = W.kept_units(ids, 8, 0.5, 3, 11)
    assert set(np.unique(m)) == {0.0, 2.0} and abs(m.mean() - 1) < 0.05
    assert (W.kept_units(ids[100:200], 8, 0.5, 3, 11) == m[100:200]).all() and (W.kept_units(ids, 8, 0.5, 3, 12) != m).any()
    rng = np.random.default_rng(4)
    _, _, _, _, e, f, nodes = graph(spark, rng)
    net, found = W.Convolution(hidden=4, dropout=0.5, seed=9), []
    for hub, size in ((1 << 16, 4096), (3, 2)):
        found.append(net.loss_and_gradient(W.convolution_blocks(e, f, nodes, 3, hub, size), net.first(3, 7), epoch=2))
    assert np.isclose(found[0][0], found[1][0]) and close(*[x[1] for x in found])


@pytest.mark.parametrize(("hub", "size"), [(1 << 16, 4096), (5, 3), (1, 1)])
def test_attention(spark, hub, size):
    """Also with split nodes in both layers, down to every node being split."""
    rng = np.random.default_rng(3)
    a, _, x, y, e, f, nodes = graph(spark, rng, n=9)
    net = W.Attention(hidden=2, heads=3, act="relu")
    params = net.first(3, 7) | {"b0": rng.standard_normal(6) * 0.1}
    blocks = W.attention_blocks(e, f, nodes, 3, hub, size)
    assert (blocks.split_nodes is not None) == (hub < 9)
    dense = lambda p: dense_attention(a, x, p, 3, 2)
    assert np.allclose(scores(net.scores(blocks, params)), W.softmax(dense(params))[:, 1])
    loss, grads = net.loss_and_gradient(blocks, params)
    assert np.isclose(loss, mean_loss(dense(params), y)) and close(numeric(lambda p: mean_loss(dense(p), y), params), grads)


def test_attention_shares_and_training(spark):
    rng = np.random.default_rng(6)
    a, _, x, y, e, f, nodes = graph(spark, rng)
    net = W.Attention()
    blocks = W.attention_blocks(e, f, nodes, 3)
    rows = net.shares(blocks, net.first(3, 1)).groupBy("dst", "head").agg({"share": "sum"}).collect()
    assert len(rows) == len(x) * 8 and np.allclose([r[2] for r in rows], 1)
    trained = net.train(blocks, 3, 6, 0.02)
    assert trained.losses[-1] < trained.losses[0]
    # Large logits neither overflow nor lose their shares.
    big = {k: v * 400 for k, v in net.first(3, 1).items()}
    assert np.isfinite(scores(net.scores(blocks, big))).all()
