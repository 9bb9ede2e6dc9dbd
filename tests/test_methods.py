"""Composed methods and samples on small graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddgraph.operators import classifiers as C
from oddgraph.operators import detectors as D
from oddgraph.operators import metrics as M
from oddgraph.operators import sampling as S


@pytest.fixture(scope="module")
def graph(spark):
    """Two rings joined by a few edges; anomalies have shifted features; every third label is known."""
    rng = np.random.default_rng(0)
    n = 40
    x, y = rng.standard_normal((n, 3)), [int(i % 5 == 0) for i in range(n)]
    pairs = {(i, (i + 1) % 20) for i in range(20)} | {(20 + i, 20 + (i + 1) % 20) for i in range(20)} | {(0, 20), (7, 33)}
    both = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    nodes = spark.createDataFrame([(i, (x[i] + 2.0 * y[i]).tolist(), y[i] if i % 3 else None) for i in range(n)], "id long, f array<double>, y int")
    return spark.createDataFrame(both, "src long, dst long, w double"), nodes.cache()


@pytest.mark.parametrize("method", [C.mlp, C.gcn, C.gat, C.bwgnn, C.ghrn])
def test_baselines_score_every_target_node(graph, method):
    e, nodes = graph
    s = {C.mlp: C.MLP, C.gcn: C.GCN, C.gat: C.GAT, C.bwgnn: C.BWGNN, C.ghrn: C.GHRN}[method].but(epochs=3, rate=0.01)
    target = (e, nodes.withColumn("y", F.lit(None).cast("int")))
    got = {r["id"]: r["score"] for r in method(graph, target, 3, s, seed=1).collect()}
    again = {r["id"]: r["score"] for r in method((e.repartition(5), nodes.repartition(4)), target, 3, s, seed=1).collect()}
    assert sorted(got) == list(range(40)) and all(0 < v < 1 for v in got.values())
    assert all(got[i] == pytest.approx(again[i], abs=1e-9) for i in got)


def test_pruned_passes_train_once_each(graph, monkeypatch):
    """On one graph as source and target: one training before the pruning and one after it, each over one set of features."""
    trained, made = [], []
    train, bands = C.W.Perceptron.train, C.wavelet_features
    monkeypatch.setattr(C.W.Perceptron, "train", lambda self, blocks, width, epochs, *a: trained.append(epochs) or train(self, blocks, width, epochs, *a))
    monkeypatch.setattr(C, "wavelet_features", lambda *a: made.append(1) or bands(*a))
    got = C.ghrn(graph, graph, 3, C.GHRN.but(epochs=3, rate=0.01), seed=1)
    assert (trained, len(made)) == ([3, 3], 2)
    apart = C.ghrn(graph, (graph[0], graph[1]), 3, C.GHRN.but(epochs=3, rate=0.01), seed=1)
    got, apart = (np.array(sorted(map(tuple, x.collect()))) for x in (got, apart))
    assert len(trained) == 4 and np.allclose(got, apart, atol=1e-9)


def test_augmented_table(graph):
    e, nodes = graph
    rows = {r["id"]: r["f"] for r in C.augmented(e, nodes.select("id", "f"), 3, positions=4).collect()}
    assert len(rows) == 40 and {len(f) for f in rows.values()} == {3 + 2 + 4 + 3 * 3}
    assert rows[0][3] == pytest.approx(np.log1p(3)) and sum(np.exp(f[4]) for f in rows.values()) == pytest.approx(1)


def test_truncated_affinity_and_reconstruction(graph):
    e, nodes = graph
    score = {r["id"]: r["score"] for r in D.tam(e, nodes, 3, cuttings=2, trees=2, seed=3).collect()}
    assert len(score) == 40 and min(score.values()) == 0 and max(score.values()) == 1
    a = np.eye(40)
    for r in e.collect():
        a[r["src"], r["dst"]] += 1
    x = np.array([r["f"] for r in nodes.orderBy("id").collect()])
    root = a.sum(1) ** -0.5
    m = root[:, None] * a.T * root[None]
    z = m @ x
    want = 0.8 * np.linalg.norm(x - m @ z, axis=1) + 0.2 * np.linalg.norm(z @ z.T - a, axis=1)
    got = {r["id"]: r["score"] for r in D.dominant(e, nodes, 3).collect()}
    assert np.allclose([got[i] for i in range(40)], want)


@pytest.mark.parametrize("k", [0, 1, 5, 37, 99, 100, 140])
def test_smallest_rows_with_ties(spark, k):
    rows = [((i * 7) % 5 / 2, (i * 3) % 4, i) for i in range(100)]
    df = spark.createDataFrame(rows, "v double, src long, dst long").repartition(3)
    assert sorted(map(tuple, M.smallest(df, k, ["v", "src", "dst"]).collect())) == sorted(rows)[:k]


def test_batches_are_balanced_and_disjoint(spark):
    rows = [(g, 100 * k + i, int(i % 4 == 0), i % 7 > 0) for k, (g, n) in enumerate((("a", 60), ("b", 24), ("few", 3), ("one", 3))) for i in range(n)]
    nodes = spark.createDataFrame(rows, "graph string, id long, y int, mark boolean")
    marked = {r[1]: (r[0], r[2]) for r in rows if r[3]}
    steps: dict = {}
    for r in S.source_batches(nodes, 2, 3, 30, 5).collect():
        steps.setdefault(r["step"], []).append(r)
    assert sorted(steps) == list(range(30)) and {r["graph"] for x in steps.values() for r in x} == {"a", "b"}
    for x in steps.values():
        ids = [r["id"] for r in x]
        assert len(set(ids)) == len(ids) and len({r["graph"] for r in x}) == 1 and all(marked[r["id"]] == (r["graph"], r["y"]) for r in x)
        query = [r["y"] for r in x if r["role"] == "query"]
        assert [r["y"] for r in x if r["role"] == "context"] == [0, 0] and query.count(0) == query.count(1) == 3
    one = nodes.where("graph = 'b'").drop("graph")
    got = S.context_and_query(one, 4, 50, 1).collect()
    least = min(sum(m == ("b", 0) for m in marked.values()) - 4, sum(m == ("b", 1) for m in marked.values()))
    assert [sum(r["role"] == "query" and r["y"] == c for r in got) for c in (0, 1)] == [least, least]
    assert sum(r["role"] == "context" for r in got) == 4 and S.context_and_query(one, 10**6, 3, 1).where("role = 'query'").isEmpty()
    rate = S.train_rate(one, 0.3, 2).collect()
    assert len({r["id"] for r in rate}) == int(0.3 * 24) and {r["id"] for r in S.train_rate(one.repartition(6), 0.5, 2).collect()} > {r["id"] for r in rate}


def test_attention_and_losses_of_large_logits(spark):
    big = spark.createDataFrame([(i, [1000.0 * (i + 1), 0.0]) for i in range(3)], "id long, f array<double>")
    assert all(np.isfinite(r["score"]) for r in D.support_attention(big, big, 2).collect())
    hops = big.select("id", F.col("f").alias("h0"), F.transform("f", lambda v: v * 2).alias("h1"), F.transform("f", lambda v: v * 3).alias("h2"))
    assert all(np.isfinite(r["f"]).all() for r in D.hop_attention(hops, 2, 2).collect())
    t = spark.createDataFrame([(0, 1, 2)], "anchor long, positive long, negative long")
    assert D.link_loss(t, big, 1e-4).first()["loss"] == pytest.approx(0.0, abs=1e-6)
