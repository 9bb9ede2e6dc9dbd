"""Eigenvectors over distributed products against dense decompositions."""

import os

import numpy as np
import pytest

from oddgraph.operators import spectral as E
from tests.test_graph import edges, nodes


def graph(spark):
    """Two components of 60 and 40 nodes and one node alone."""
    rng = np.random.default_rng(1)
    rows = [(a + o, (a + 1) % n + o, 1) for n, o in ((60, 0), (40, 60)) for a in range(n)]
    rows += [(int(a), int(b), 1 + (a + b) % 3) for a, b in rng.integers(0, 60, (40, 2)) if a != b] + [(int(a), int(b), 2) for a, b in rng.integers(60, 100, (25, 2)) if a != b]
    a = np.zeros((101, 101))
    for i, j, w in rows:
        a[i, j] = a[j, i] = max(a[i, j], w)
    return edges(spark, [(i, j, float(w)) for i, j, w in rows]), nodes(spark, [[0]] * 101).select("id"), a


def vectors(found):
    got = {r["id"]: r["f"] for r in found.vectors.collect()}
    return np.array([got[i] for i in range(len(got))])


@pytest.mark.parametrize("piece", [4096, 2])
def test_laplacian_positions(spark, monkeypatch, piece):
    monkeypatch.setattr(E, "PIECE", piece)
    e, ids, a = graph(spark)
    d = a.sum(1)
    s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    laplacian = np.eye(101) - s[:, None] * a * s[None]
    values, v = np.linalg.eigh(laplacian)
    first = np.flatnonzero(values > 1e-9)[:4]
    found = E.laplacian_positions(e, ids, 4, 1e-7)
    x = vectors(found)
    assert x.shape == (101, 4) and np.allclose(found.values, values[first], atol=1e-9) and found.residuals.max() < 1e-6
    assert np.abs(laplacian @ x - x * found.values).max() < 1e-6 and np.allclose(x.T @ x, np.eye(4), atol=1e-7)
    assert (x[np.abs(x).argmax(0), np.arange(4)] > 0).all()
    assert np.allclose(np.abs((v[:, first] * x).sum(0)), 1, atol=1e-6)


def test_laplacian_svd(spark):
    e, ids, a = graph(spark)
    laplacian = np.diag(a.sum(1)) - a
    values, v = np.linalg.eigh(laplacian)
    found = E.laplacian_svd(e, ids, 6, 1e-7)
    x = vectors(found)
    want = np.sqrt(np.var(laplacian @ v[:, ::-1][:, :6], axis=0))
    assert np.allclose(found.values, want, atol=1e-6) and np.allclose(np.abs((v[:, ::-1][:, :6] * x).sum(0)), 1, atol=1e-5)


def test_components_and_too_many_vectors(spark):
    e, ids, _ = graph(spark)
    got = dict(map(tuple, E.components(e, ids).collect()))
    assert got == {i: 0 if i < 60 else 60 if i < 100 else 100 for i in range(101)}
    with pytest.raises(ValueError, match="asked for"):
        E.laplacian_positions(e.where("src < 3 and dst < 3"), ids.where("id < 3"), 5)


@pytest.mark.parametrize("piece", [4096, 3])
def test_blocks_give_what_one_block_gives(spark, monkeypatch, piece):
    """Several blocks that exchange values, components that lie in several of them, blocks without a node."""
    e, ids, _ = graph(spark)
    want = vectors(E.laplacian_positions(e, ids, 4, 1e-7))
    monkeypatch.setattr(E, "PIECE", piece)
    monkeypatch.setattr(E.B, "blocks", lambda n: 7)
    assert np.allclose(vectors(E.laplacian_positions(e, ids, 4, 1e-7)), want, atol=1e-6)
    few, count = ids.where("id in (60, 61, 62)"), 7
    assert E.B.over(E.B.packed(few.withColumn("v", E.F.lit(0)), e.where("false"), count, lambda q, fixed, i, v: (0, [])), lambda fixed, x: E.pa.RecordBatch.from_arrays([E.pa.array(fixed.ids)], ["id"]), "id long").count() == 3


def test_a_round_leaves_no_files_of_earlier_ones(spark):
    """What an iteration has written is deleted with the round after it, the shuffled files with their own."""
    e, ids, _ = graph(spark)
    made = []

    def cut(df):
        made.append(E_cut(df))
        return made[-1]

    E_cut = E.cut
    with pytest.MonkeyPatch.context() as m:
        m.setattr(E, "cut", cut)
        found = E.laplacian_positions(e, ids, 4, 1e-7)
    left = [os.path.exists(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")) for df in made if "q" in df.columns]
    assert len(left) > 1 and not any(left[:-1]) and left[-1]
    assert found.vectors.count() == 101
