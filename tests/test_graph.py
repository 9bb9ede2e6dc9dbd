"""Hand-computed values of the graph operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddgraph.functions import exprs as X
from oddgraph.operators import edges as G
from oddgraph.operators import features as FT
from oddgraph.operators import metrics as M
from oddgraph.operators import neighbours as N
from oddgraph.operators import propagate as P
from oddgraph.operators import sampling as S
from oddgraph.sources import graphs as src


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double")


def nodes(spark, fs):
    return spark.createDataFrame([(i, [float(x) for x in f]) for i, f in enumerate(fs)], "id long, f array<double>")


def table(e):
    return {(r["src"], r["dst"]): round(r["w"], 9) for r in e.collect()}


def test_cleaning(spark):
    dirty = edges(spark, [(0, 0, 7), (0, 1, 2), (1, 0, 4), (2, 1, 3), (2, 2, 9)])
    assert table(G.undirected(dirty)).keys() == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert table(G.undirected(edges(spark, [(0, 1, 0), (1, 2, 1)]))).keys() == {(1, 2), (2, 1)}
    directed = edges(spark, [(0, 0, 1), (0, 1, 3), (1, 2, 2)])
    assert table(G.binary(directed)) == {(0, 0): 1, (0, 1): 1, (1, 2): 1}
    assert table(G.binary(edges(spark, [(0, 0, 1), (0, 1, 3), (1, 2, 2), (2, 2, 4)]), keep_loops=False)).keys() == {(0, 1), (1, 2)}


def test_normalisations(spark):
    n3 = nodes(spark, [[0]] * 3)
    pair = edges(spark, [(0, 1, 1), (1, 0, 1)])
    assert table(G.norm_sym_transposed(G.unit_loops(pair, n3))) == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 0.5, (2, 2): 1.0}
    assert set(table(G.norm_sym_transposed(G.unit_loops(edges(spark, [(0, 0, 1), (0, 1, 1), (1, 0, 1)]), nodes(spark, [[0]] * 2)))).values()) == {0.5}
    five = edges(spark, [(0, 0, 2), (0, 1, 3), (1, 2, 1), (3, 0, 1)])
    got = table(G.norm_sym_directed(five, nodes(spark, [[0]] * 5)))
    assert got[(0, 0)] == 0.5 and (1, 0) not in got and got[(4, 4)] == 1.0
    four = G.unit_loops(edges(spark, [(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 3, 1)]), nodes(spark, [[0]] * 4))
    assert table(G.norm_both(four))[(2, 0)] == round(1 / math.sqrt(3 * 3), 9)
    assert table(G.norm_row(edges(spark, [(0, 1, 1), (0, 2, 3)]))) == {(0, 1): 0.25, (0, 2): 0.75}


def test_products_and_direction(spark):
    e, x = edges(spark, [(0, 1, 2), (1, 2, 3)]), nodes(spark, [[1], [10], [100]])
    value = lambda d: [r["f"][0] for r in d.orderBy("id").collect()]
    assert value(P.spmm(e, x, 1)) == [20, 300, 0]
    assert value(P.spmm_t(e, x, 1)) == [0, 2, 30]
    assert value(P.neighbour_aggregate(e, x, 1, "max")) == [0, 1, 10]
    hops = P.propagate(G.undirected(edges(spark, [(0, 1, 1)])), x, 1, 1).orderBy("id").collect()
    assert [r["h1"][0] for r in hops] == pytest.approx([5.5, 5.5, 100.0])
    assert P.beta_theta(2) == [[3, -3, 0.75], [0, 3, -1.5], [0, 0, 0.75]]


def test_structure(spark):
    e = G.undirected(edges(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1)]))
    x = nodes(spark, [[0]] * 5)
    local = N.clustering(e, x)
    got = {r["id"]: (r["degree"], r["clustering"]) for r in local.collect()}
    assert got == {0: (2 / 3, 1.0), 1: (2 / 3, 1.0), 2: (1.0, pytest.approx(1 / 3)), 3: (1 / 3, 0.0), 4: (0.0, 0.0)}
    pooled = {r["id"]: r["pooled_clustering"] for r in N.structural_fingerprint(local, e, ["degree", "clustering"]).collect()}
    assert pooled[0] == pytest.approx((1 + 1 / 3) / 2) and pooled[4] == 0
    assert sorted(r["id"] for r in P.k_core(e, 2).collect()) == [0, 1, 2]
    two = N.compatible_mean(G.undirected(edges(spark, [(0, 1, 1)])), spark.createDataFrame([(0, [0.0]), (1, [0.0])], "id long, f array<double>"), 1)
    assert [r["topology"] for r in two.collect()] == [0.0, 0.0]


def test_closure_keeps_weights(spark):
    chain = edges(spark, [(i, i + 1, i + 1) for i in range(10)])
    ids = P.closure(chain, spark.createDataFrame([(4,), (0,), (4,)], "id long"), 3)
    assert sorted(r["id"] for r in ids.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert table(P.induced(chain, ids))[(6, 7)] == 7.0


def test_scaling(spark):
    m = [r["f"] for r in N.minmax_columns(nodes(spark, [[1, 5, 2], [3, 5, 0], [5, 5, 4]]), 3).orderBy("id").collect()]
    assert m == [[0, 0, 0.5], [0.5, 0, 0], [1, 0, 1]]
    assert [r["f"] for r in FT.row_normalised(nodes(spark, [[1, 3], [0, 0], [2, 0]])).orderBy("id").collect()] == [[0.25, 0.75], [0, 0], [1, 0]]
    assert [r["f"] for r in FT.sign_rule(nodes(spark, [[-5, 0, 1], [2, 0, -3]]), 3).orderBy("id").collect()] == [[5, 0, -1], [-2, 0, 3]]
    path = G.undirected(edges(spark, [(0, 1, 1), (1, 2, 1)]))
    got = {r["j"]: r["score"] for r in N.smoothness_composite(path, nodes(spark, [[0, 0, 4], [0.5, 1, 4], [1, 0, 4]]), 3, 0.5).collect()}
    assert got == pytest.approx({0: 0.5 * 0.25 + 0.5 / 6, 1: 0.5 + 0.5 * 2 / 9, 2: 0.0})
    support = spark.createDataFrame([(0, [4.0, 0.0]), (0, [0.0, 2.0]), (1, [-2.0, 0.0]), (1, [0.0, -6.0])], "y int, f array<double>")
    assert {r["y"]: r["c"] for r in FT.prototypes(support, 2, (0, 1, 2)).collect()} == {0: [2, 1], 1: [-1, -3], 2: [0, 0]}


def scores(spark, ys, ss, marks=None):
    rows = [(i, y, float(s), True if marks is None else bool(marks[i])) for i, (y, s) in enumerate(zip(ys, ss))]
    return spark.createDataFrame(rows, "id long, y int, score double, mark boolean")


def test_metrics(spark):
    assert M.recall_at_k(scores(spark, [0, 1, 1, 0], [1, 1, 1, 1])).first()[0] == 0.5
    assert math.isnan(M.recall_at_k(scores(spark, [0, 0], [1, 2])).first()[0])
    masked = scores(spark, [0, 1, 1, -1], [0.8, 0.7, 100, 200], [1, 1, 0, 0])
    assert M.evaluate(masked, "recall-at-k").first()[0] == 0
    assert M.auroc(scores(spark, [0, 0], [1, 2])).first()[0] is None
    got = M.evaluate(scores(spark, [0, 1, 0, 1, 1], [0.1, 0.4, 0.4, 0.8, 0.1])).first()
    pairs = [(a, b) for a in (0.4, 0.8, 0.1) for b in (0.1, 0.4)]
    assert got["auroc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / 6)


def test_reports(spark):
    rows = spark.createDataFrame([("c", 1, s, t, "ok", v) for s, t, v in ((2, "a", 0.1), (2, "b", 0.9), (7, "a", 0.3), (7, "b", 0.7))], "context_id string, shot int, seed int, target string, status string, auroc double")
    assert tuple(M.shot_macro(rows, 1, 2).select("mean", "std").first()) == pytest.approx((0.5, 0.0))
    bad = rows.union(spark.createDataFrame([("c", 1, 2, "c", "ok", 0.2), ("c", 1, 7, "c", "failed", None)], rows.schema))
    assert M.shot_macro(bad, 1, 2).first()["targets"] == 2
    detail = {r["target"]: (r["n"], r["status"]) for r in M.shot_detail(bad, 2).collect()}
    assert detail == {"a": (2, "ok"), "b": (2, "ok"), "c": (1, "incomplete")}


def test_samples(spark):
    pool = spark.createDataFrame([(i, i % 2 if i < 40 else -1, i < 40) for i in range(42)], "id long, y int, mark boolean")
    small, large = (set(r["id"] for r in S.holdout(pool, k, 1).where("role = 'support'").collect()) for k in (3, 10))
    assert small < large and len(large) == 10
    flipped = pool.withColumn("y", 1 - F.col("y"))
    assert set(r["id"] for r in S.holdout(flipped, 3, 1).where("role = 'support'").collect()) == small
    scarce = spark.createDataFrame([(0, 0, True), (1, 0, True), (2, 1, True), (3, 1, True), (4, -1, False)], "id long, y int, mark boolean")
    got = S.per_class_reserving(scarce, 3, 0).collect()
    assert len(got) == 6 and len({r["id"] for r in got}) == 2
    with pytest.raises(ValueError):
        S.per_class(scarce, 3, 0, strict=True)
    ring = G.undirected(edges(spark, [(i, (i + 1) % 12, 1) for i in range(12)]))
    free = S.non_neighbours(ring, nodes(spark, [[0]] * 12), 3, 5).collect()
    assert len(free) == 36 and all((r["id"] - r["cand"]) % 12 not in (0, 1, 11) for r in free)


def test_knn_against_brute_force_and_partitions(spark):
    import numpy as np

    v = np.random.default_rng(0).standard_normal((60, 5))
    df = nodes(spark, v.tolist()).withColumn("u", X.unit("f"))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-sims[i])[:3]}
    for block in (1000, 16):
        assert {(r["src"], r["dst"]) for r in src.knn_edges(df, 3, block).collect()} == want


def test_stream(spark, tmp_path):
    from oddgraph.streaming import edges as T

    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(id * 600) AS ts, id % 3 AS user_id, 'a' AS event_type, 1.0D AS value, '' AS props FROM range(24)")
    rows.write.parquet(str(tmp_path / "in"))
    q = T.windowed_edges(T.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("edges_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("edges_out").agg(F.max("w")).first()[0] == 2


def test_protocol(spark):
    from oddgraph.plans import protocol

    def method(s, sources, target, seed, hp):
        if target == "bad":
            raise ValueError("no such graph")
        return scores(s, [0, 1], [0.1, 0.9])

    plan = protocol.Plan({"m": method}, {"single": ("a",), "multi": ("a", "b")}, ("t", "bad"), (0, 1))
    rows = protocol.run(spark, plan)
    assert rows.where("status = 'failed'").count() == 4 and rows.where("auroc = 1.0").count() == 4
    assert protocol.run(spark, plan, rows).count() == 8
    assert protocol.result_name("a.csv", "recall-at-k") == "a_recall_at_k.csv"


def test_npz_and_demo(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "g.npz", x=np.eye(4), y=np.array([0, 1, 0, 1]), edge_index=np.array([[0, 1], [1, 2]]), train_mask=np.array([0]), valid_mask=np.array([2]), test_mask=np.array([], int))
    n, e = src.npz_graph(spark, str(tmp_path / "g.npz"))
    assert [r["mark"] for r in n.orderBy("id").collect()] == [True, False, True, False] and e.count() == 2
    n, e = src.demo_graph(spark)
    assert n.count() == 128 and n.where("y = 1").count() == 24 and e.where("src = dst").isEmpty()


def test_losses_run_over_all_pairs(spark):
    """Edges between distant ids count as positives, and denominators run over all nodes."""
    import numpy as np

    from oddgraph.operators import detectors as D

    n, rng = 130, np.random.default_rng(3)
    f, g = rng.standard_normal((n, 4)), rng.standard_normal((n, 4))
    pairs = [(i, (i + k) % n) for i in range(n) for k in (1, 57)]
    w = np.zeros((n, n))
    for a, b in pairs:
        w[a, b] = 1 + (a + b) % 3
    df = spark.createDataFrame([(i, f[i].tolist(), g[i].tolist()) for i in range(n)], "id long, f array<double>, g array<double>").withColumn("u", X.unit("f"))
    e = edges(spark, [(a, b, w[a, b]) for a, b in pairs])
    u, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (f, g))
    k = np.exp(u @ u.T / 0.5)
    per = -np.log((k * (w > 0)).sum(axis=1) / k.sum(axis=1))
    assert D.contrast_loss(e, df, tau=0.5).first()[0] == pytest.approx(per.mean())
    assert D.contrast_loss(e, df, batch=100, tau=0.5).first()[0] == pytest.approx((per[:100].mean() + per[100:].mean()) / 2)
    for block in (2048, 40):
        got = {r["id"]: r["t"] for r in D.exp_sums(df, "u", "u", 0.5, block).collect()}
        assert [got[i] for i in range(n)] == pytest.approx(k.sum(axis=1).tolist())
    s, want = u @ v.T, 0.0
    for t, y in ((s, w), (s.T, w.T)):
        z = np.log(np.exp(t).sum(axis=1))
        want += (z - np.diag(t)).mean() + ((y * (z[:, None] - t)).sum(axis=1) / y.sum(axis=1)).mean()
    assert D.alignment_loss(e, df).first()[0] == pytest.approx(want / 2)


def test_metrics_against_plain_ranks_with_ties_and_outliers(spark):
    rng = np.random.default_rng(3)
    score = np.concatenate([np.round(rng.normal(size=150), 1), [1e9, -1e9, 0.0, 0.0]])
    y = rng.integers(0, 2, len(score))
    df = spark.createDataFrame([(i, float(s), int(t)) for i, (s, t) in enumerate(zip(score, y))], "id long, score double, y int")
    above = (score[:, None] > score[None, :]) + 0.5 * (score[:, None] == score[None, :])
    assert M.auroc(df).first()[0] == pytest.approx(above[y == 1][:, y == 0].mean())
    tops = sorted(set(score[y == 1]), reverse=True)
    want = sum(y[score == s].sum() * y[score >= s].sum() / (score >= s).sum() for s in tops) / y.sum()
    assert M.average_precision(df).first()[0] == pytest.approx(want)
    first = sorted(range(len(score)), key=lambda i: (-score[i], i))[: y.sum()]
    assert M.recall_at_k(df).first()[0] == pytest.approx(y[first].sum() / y.sum())


def test_ranks_count_every_row_once(spark):
    nodes = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2) for i in range(500)], "id long, y int")
    assert sorted(x["r"] for x in S.ranked(nodes, 5).collect()) == list(range(1, 501))
    got = S.ranked(nodes, 5, ["y"]).toPandas()
    assert len(got) == 500 and all(sorted(g["r"]) == list(range(1, len(g) + 1)) for _, g in got.groupby("y", dropna=False))


def test_diversity_of_hubs_and_small_nodes(spark):
    rng = np.random.default_rng(4)
    u = rng.normal(size=(12, 4))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(u)], "id long, u array<double>")
    ends = {0: range(1, 12), 1: range(2, 5), 2: [3]}
    e = spark.createDataFrame([(a, b) for a, bs in ends.items() for b in bs], "src long, dst long")
    got = {x["id"]: x["m"] for x in N.diversity(e, nodes, 4).collect()}
    for a, bs in ends.items():
        bs = list(bs)
        c = [u[p] @ u[q] for i, p in enumerate(bs) for q in bs[:i]]
        assert got[a] == pytest.approx(np.var(c) if c else 0.0, abs=1e-9)
    assert got[5] == 0.0
