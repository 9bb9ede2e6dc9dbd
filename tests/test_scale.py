"""What jobs over all pairs and other wide steps may cost, besides their results."""

import hashlib
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector

from oddgraph.operators import detectors as D
from oddgraph.operators import networks as NW
from oddgraph.operators import propagate as P
from oddgraph.plans import queries as Q
from oddgraph.plans.oracle import ORACLE
from oddgraph.sources import graphs as src

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def vectors(spark, u, ids=None):
    return spark.createDataFrame(pa.table({"id": np.arange(len(u)) if ids is None else ids, "u": u.tolist()}))


@needs_tables
@pytest.mark.parametrize("name", ["norm_sym_transposed", "norm_residual_pair", "lookup_edges", "link_loss", "closure_induced", "undirect_binary", "affinity_col"])
def test_neighbours_are_searched_once(spark, name):
    """The plan that is left over reads the edges, it doesn't search them again for each of its uses."""
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsIn" not in plan


def test_copies_of_a_node_do_not_grow(spark):
    assert [src.strips(spark.range(n)) for n in (0, 2048, 20_480, 100_000, 500_000)] == [1, 1, 10, 16, 16]


@pytest.mark.parametrize("block", [40, 400])
def test_neighbours_with_copies_and_bad_vectors(spark, block):
    rng = np.random.default_rng(0)
    u = np.round(rng.normal(size=(300, 6)), 1)
    u /= np.linalg.norm(u, axis=1)[:, None]
    u[100:160], u[::37] = u[7], np.nan
    ids = rng.permutation(1000)[:300]
    got = sorted(map(tuple, src.knn_edges(vectors(spark, u, ids), 5, block).collect()))
    want, good = [], np.flatnonzero(np.isfinite(u).all(axis=1))
    for i in good:
        w = np.round(u[good] @ u[i], 12)
        best = [j for j in np.lexsort((ids[good], -w)) if good[j] != i][:5]
        want += [(ids[i], ids[good[j]], w[j]) for j in best]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], atol=2e-12)


@pytest.mark.parametrize("block", [1500, 5000])
def test_neighbours_over_several_tiles(spark, block):
    """More rows and columns than a tile has, in numbers that no tile divides."""
    rng = np.random.default_rng(1)
    u = rng.normal(size=(4333, 8))
    u /= np.linalg.norm(u, axis=1)[:, None]
    u[2000:2040] = u[5]
    got = src.knn_edges(vectors(spark, u), 3, block).toPandas().sort_values(["src", "w", "dst"], ascending=[True, False, True])
    w = np.round(u @ u.T, 12)
    np.fill_diagonal(w, -9)
    want = np.argsort(-w, axis=1, kind="stable")[:, :3]
    assert len(got) == want.size
    assert np.allclose(got["w"].to_numpy().reshape(want.shape), np.take_along_axis(w, want, axis=1), atol=2e-12)
    assert (got["dst"].to_numpy().reshape(want.shape) == want).mean() > 0.999  # equal weights may differ in the twelfth place


def test_neighbours_are_merged_by_pieces(spark):
    """Not by a window over k rows a node from each strip; and a million nodes still have 16 copies."""
    u = np.eye(4)
    assert "Window" not in src.knn_edges(vectors(spark, u), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert src.strips(spark.range(1_000_000), most=src.WIDE) == 16


def test_a_pair_of_strips_hands_over_what_reaches_the_best_so_far():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(2, 700, 5))
    u /= np.linalg.norm(u, axis=2)[:, :, None]
    u[1, :20] = u[0, 3]  # equal weights: the floor itself is handed over
    ids = [np.arange(700), np.arange(700, 1400)]
    own = [src._weigh([i], [x], None, [np.full(700, -np.inf)], 4, None)[0] for i, x in zip(ids, u, strict=True)]
    both = src._weigh(ids, list(u), None, [x.w[:, -1] for x in own], 4, None)
    every = np.round(np.concatenate(u) @ np.concatenate(u).T, 12)
    np.fill_diagonal(every, -9)
    for i, (mine, other) in enumerate(zip(own, both, strict=True)):
        found = np.isfinite(other.w)
        assert (other.w[found] >= np.broadcast_to(mine.w[:, -1:], found.shape)[found]).all() and found.sum() < found.size
        best = -np.sort(-np.concatenate([mine.w, other.w], axis=1), axis=1)[:, :4]
        assert np.allclose(best, -np.sort(-every[700 * i : 700 * i + 700], axis=1)[:, :4], atol=2e-12)


@pytest.mark.parametrize("alone", [True, False])
def test_products_of_many_tiles_are_weighed_together(monkeypatch, alone):
    """Not tile by tile, each with a sort of its own; the neighbours are those of brute force."""
    calls, real = [], src._Nearest.offer
    monkeypatch.setattr(src, "SIDE", 32)
    monkeypatch.setattr(src._Nearest, "offer", lambda self, *x: calls.append(len(x[0])) or real(self, *x))
    rng = np.random.default_rng(3)
    u = np.split(rng.normal(size=(700, 5)), [400])[: 1 if alone else 2]
    u = [x / np.linalg.norm(x, axis=1)[:, None] for x in u]
    u[0][50:90] = u[0][3]  # more equal weights than a row keeps
    ids = np.split(rng.permutation(700), [400])[: len(u)]
    got = src._weigh(ids, u, None, [np.full(len(x), -np.inf) for x in u], 4, None)
    for me, best in enumerate(got):
        it = len(u) - 1 - me
        w = np.round(np.einsum("ij,kj->ik", u[me], u[it]), 12)
        w[ids[me][:, None] == ids[it]] = -9
        want = np.lexsort((np.broadcast_to(ids[it], w.shape), -w), axis=1)[:, :4]
        assert np.allclose(best.w, np.take_along_axis(w, want, axis=1), atol=2e-12)
        assert (best.id == ids[it][want]).mean() > 0.99  # equal weights may differ in the twelfth place
    assert len(calls) < len(u[0]) * len(u[-1]) / 32**2 / (4 if alone else 2)


@pytest.mark.parametrize("block", [3, 30])
def test_neighbours_of_odd_tables(spark, block):
    """No rows, no finite rows, fewer rows than k, no id, int ids, and an id that two rows have: as in SQL, 3 in all."""
    none = spark.createDataFrame([], "id int, u array<double>")
    bad = spark.createDataFrame([(1, None), (2, [float("nan"), 0.0])], "id int, u array<double>")
    assert not src.knn_edges(none, 3, block).count() and not src.knn_edges(bad, 3, block).count()
    rows = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in ((None, 0.1), (1, 0.0), (2, 0.3), (3, 0.7))]
    few = spark.createDataFrame(rows, "id int, u array<double>")
    assert {(r["src"], r["dst"]) for r in src.knn_edges(few, 5, block).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    more = rows[1:] + [(i, [float(np.cos(i)), float(np.sin(i))]) for i in (1, 4, 5, 6, 7, 8)]
    con = duckdb.connect()
    con.execute("CREATE TABLE vec (id INT, u DOUBLE[])")
    con.executemany("INSERT INTO vec VALUES (?, ?)", more)
    near = "row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.u, b.u), 12) DESC, b.id) AS r"
    want = con.execute(f"SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, {near} FROM vec a, vec b WHERE a.id <> b.id) WHERE r <= 3 ORDER BY 1, 2").fetchall()
    assert sorted((r["src"], r["dst"]) for r in src.knn_edges(spark.createDataFrame(more, "id int, u array<double>"), 3, block).collect()) == want


def test_a_round_of_pagerank_is_made_once(spark):
    """What is left over reads the last round's sums; it doesn't make the weights or earlier rounds again."""
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    got = P.pagerank(e, spark.range(3), 3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    a, p = np.array([[0, 1, 0], [0.5, 0, 0.5], [0, 0, 0]]), np.full(3, 1 / 3)
    for _ in range(3):
        p = 0.05 + 0.85 * (p @ a + (1 - (p @ a).sum()) / 3)
    assert np.allclose([r["p"] for r in got.orderBy("id").collect()], p)
    assert not P.pagerank(e.limit(0), spark.range(0), 3).count()


def test_marked_places():
    rng = np.random.default_rng(0)
    for n in (0, 5, 8, 1003):
        for share in (0, 0.01, 1):
            marks = rng.random(n + 8)[8:] < share
            assert (src._true(marks) == np.flatnonzero(marks)).all()


def test_sums_of_pairs_both_ways(spark):
    rng = np.random.default_rng(0)
    f, g = rng.normal(size=(2, 90, 4))
    df = spark.createDataFrame(pa.table({"id": np.arange(90), "f": f.tolist(), "g": g.tolist()}))
    for right, v in (("g", g), ("f", f)):
        for block in (20, 200):
            got = {x["id"]: (x["t"], x["back"]) for x in D.exp_sums(df, "f", right, 2.0, block).collect()}
            t = np.exp(f @ v.T / 2)
            assert np.allclose([got[i] for i in range(90)], np.stack([t.sum(axis=1), t.sum(axis=0)], axis=1))


@needs_tables
def test_alignment_makes_the_products_once(spark):
    plan = Q.alignment_loss(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsIn" not in plan


def test_weighted_loss_of_a_certain_error(spark, tmp_path):
    """A long document makes 1 - p zero: its loss is infinite, as in SQL, and isn't left out."""
    pq.write_table(pa.table({"doc_id": [0, 1, 2], "n_chars": [500, 3000, 45_000], "lang": ["en"] * 3, "source": ["a"] * 3}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [0, 1, 2], "toxic": [0, 1, 0]}), tmp_path / "labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert con.execute(ORACLE["weighted_ce"]).fetchone() == tuple(Q.weighted_ce(spark, str(tmp_path)).first()) == (float("inf"),)


@pytest.mark.parametrize("rounds", [2, 40])
def test_contexts_of_hubs_and_lone_nodes(spark, rounds):
    """Against contexts made one by one: node 0 has more neighbours than two rounds draw, node 39 has none."""
    rng, n = np.random.default_rng(0), 40
    f = rng.normal(size=(n, 3))
    near = {i: sorted(rng.choice(n, 30 if i == 0 else 3, replace=False).tolist()) for i in range(n - 1)}
    e = spark.createDataFrame([(a, b, 1.0) for a, bs in near.items() for b in bs], "src long, dst long, w double")
    nodes = spark.createDataFrame(pa.table({"id": np.arange(n), "f": f.tolist()}))
    got = {x["id"]: x["score"] for x in D.context_contrast(e, nodes, 3, rounds, batch=8).collect()}
    u = lambda *k: int(hashlib.md5(":".join(map(str, k)).encode()).hexdigest()[:8], 16) / 2**32
    mean = lambda t, i: np.mean([f[near[i][int(u(t, i, s) * len(near[i]))] if i in near else i] for s in (1, 2, 3)], axis=0)
    sigma = lambda a, b: 1 / (1 + np.exp(-a @ b))
    for i in range(n):
        other = i - 1 if i % 8 else i + 6
        assert np.isclose(got[i], np.mean([sigma(f[i], mean(t, other)) - sigma(f[i], mean(t, i)) for t in range(rounds)]))


@needs_tables
def test_no_context_is_written(spark, monkeypatch):
    """A node's contexts of 256 rounds would be 130 KB a node; the neighbours' edges are all that is cut."""
    seen, real = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: seen.append(df.columns) or real(df))
    assert Q.context_contrast(spark, SF).count() and seen == [["src", "dst", "w"]]


@pytest.mark.parametrize("radius", [0.9, 1.3])
def test_hashed_neighbours_equal_the_join_of_buckets(spark, radius):
    """Against Spark's own join of the same buckets, whose rows are pairs; ours has no join at all."""
    u = np.random.default_rng(0).normal(size=(250, 8))
    u /= np.linalg.norm(u, axis=1)[:, None]
    u[3], u[40:50] = 0, u[9]
    nodes = vectors(spark, u)
    x = nodes.select("id", "u", array_to_vector("u").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=1.0, numHashTables=4, seed=0).fit(x)
    pairs = model.approxSimilarityJoin(x, x, radius, "d").selectExpr("datasetA.id AS a", "datasetB.id AS b").where("a <> b").collect()
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append((-round(float(u[a] @ u[b]), 12), b))
    want = {(a, b) for a, found in near.items() for _, b in sorted(found)[:5]}
    for block in (60, 600):
        got = D.lsh_neighbours(nodes, 5, radius, block=block)
        assert {(r["src"], r["dst"]) for r in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_pass_has_no_tasks_without_blocks(spark):
    nodes = spark.range(300).selectExpr("id", "array(id * 1.0D, 1.0D) AS f", "int(id % 2) AS y").repartition(40)
    e = spark.range(300).selectExpr("id AS src", "(id + 1) % 300 AS dst", "1.0D AS w")
    for blocks in (NW.node_blocks(nodes, 2, 100), NW.convolution_blocks(e, nodes.select("id", "f"), nodes.select("id", "y"), 2, size=100)):
        with blocks:
            assert blocks.df.rdd.getNumPartitions() <= blocks.df.count()
            assert sum(np.frombuffer(r["ids"], np.int64).size for r in blocks.df.select("ids").collect()) == 300


def test_sums_by_place():
    rng = np.random.default_rng(0)
    at = rng.integers(0, 7, 50)
    for shape in ((50,), (50, 3), (50, 2, 3), (0, 3)):
        rows = rng.normal(size=shape)
        want = np.zeros((9, *shape[1:]))
        np.add.at(want, at[: len(rows)], rows)
        got = NW._sums(rows, at[: len(rows)], 9)
        assert got.dtype == float and (got == want).all()


@needs_tables
def test_classifiers_read_written_features(spark):
    """Neither fitting nor scores walk the edges again."""
    plan = Q.QUERIES["lr_propagated"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
