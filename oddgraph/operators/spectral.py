"""Eigenvectors of symmetric operators on a graph, by subspace iteration over distributed products.

The operator is an edge table; nodes with their entries and a few vectors a node are packed into blocks. A product is
one exchange between the blocks, and the driver sees matrices of the subspace's width alone.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.functions import exprs as X
from oddgraph.operators import edges as G
from oddgraph.operators import exchange as B
from oddgraph.operators import features as FT
from oddgraph.operators.propagate import cut, dropped

#: Vectors beyond those wanted, which speed up convergence; degree of the filter between two orthogonalisations; entries multiplied at a time; partial results that the driver adds up itself.
EXTRA, DEGREE, PIECE, PARTIALS = 8, 12, 4096, 64


def components(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): the smallest node reachable over undirected edges, by neighbours' least labels and pointer jumping."""
    both = cut(e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = cut(low.join(jump, "label").select("id", "was", F.least("label", "far").alias("label")))
        labels = step.select("id", "label")
        if step.where("label <> was").isEmpty():
            return labels


# ---- steps of a round; a block's state is (x, s), s the operator times x, or two vectors of the filter's recurrence


def _parts(fixed: tuple, x: np.ndarray) -> list[tuple[int, bytes]]:
    """For the homes of the block's labels: the labels with the sums of c times x."""
    labels, place, c, homes = fixed
    sums = np.zeros((len(labels), x.shape[1]))
    np.add.at(sums, place[place >= 0], c[place >= 0, None] * x[place >= 0])
    return [(int(h), pickle.dumps((labels[homes == h], sums[homes == h]), 5)) for h in np.unique(homes)]


def _totals(q, fixed, state, inbox):
    """A home adds up what the blocks sent by label and answers each of them in its order."""
    got = [(p, *pickle.loads(m)) for p, m in sorted(inbox.items())]
    if not got:
        return state, []
    labels, place = np.unique(np.concatenate([x for _, x, _ in got]), return_inverse=True)
    sums = np.zeros((len(labels), got[0][2].shape[1]))
    np.add.at(sums, place, np.concatenate([x for *_, x in got]))
    return state, [(p, sums[np.searchsorted(labels, x)].tobytes()) for p, x, _ in got]


def _cleared(q, fixed, state, inbox):
    """The block's vectors without their null part, sent on for a product."""
    (labels, place, c, homes), x = fixed.null, state[1].copy()
    sums = np.zeros((len(labels), x.shape[1]))
    for h in np.unique(homes):
        sums[homes == h] = np.frombuffer(inbox[int(h)], float).reshape(-1, x.shape[1])
    real = place >= 0
    x[real] -= c[real, None] * sums[place[real]]
    return (state[0], x), fixed.sent(x)


def _gram(state: DataFrame, width: int, turn: np.ndarray, many: bool) -> np.ndarray:
    """The inner products of the columns of x and s, both times ``turn``."""

    def products(_, held):
        both = np.concatenate([held[0] @ turn, held[1] @ turn], axis=1)
        return pa.RecordBatch.from_arrays([pa.array([(both.T @ both).tobytes()], pa.binary())], ["v"])

    def merge(batches):
        found = [np.frombuffer(x, float) for batch in batches for x in batch["v"].to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, axis=0).tobytes()], pa.binary())], ["v"])

    rows = B.over(state, products, "v binary")
    if many:
        rows = rows.repartition(PARTIALS).mapInArrow(merge, "v binary")
    g = np.sum([np.frombuffer(r["v"], float) for r in rows.collect()], axis=0).reshape(2 * width, 2 * width)
    return (g + g.T) / 2


def _even(g: np.ndarray) -> np.ndarray:
    """A rotation that makes columns with these inner products orthonormal: they are scaled, then rotated."""
    size = np.sqrt(np.maximum(np.diag(g), 1e-300))
    values, z = np.linalg.eigh(g / size[:, None] / size[None, :])
    return z / np.sqrt(np.maximum(values, 1e-14))[None, :] / size[:, None]


@dataclass
class Found:
    """The vectors (id, f), their values and residual norms |A v - value v|, largest values first."""

    vectors: DataFrame
    values: np.ndarray
    residuals: np.ndarray


def largest(op: DataFrame, nodes: DataFrame, k: int, low: float, null: DataFrame | None = None, tolerance: float = 1e-6, rounds: int = 60, degree: int = DEGREE, seed: int = 0) -> Found:
    """The k largest eigenvalues of a symmetric operator op(src, dst, w), whose spectrum begins at ``low``, and
    their vectors over nodes(id). null(id, label, c): known unit vectors c, one for each label, that are left out.

    Each round filters the subspace by a Chebyshev polynomial that is small from ``low`` to the subspace's
    smallest value, makes it orthonormal and rotates it to Ritz vectors. Raises ValueError if the residuals
    of the first k are not below ``tolerance`` times the largest value after so many rounds.
    """
    rows = nodes.count()
    n = rows - (null.select("label").distinct().count() if null is not None else 0)
    width = min(k + EXTRA, n)
    if k > width:
        raise ValueError(f"{k} vectors asked for, {n} there")
    count, piece, known = B.blocks(rows), PIECE, null is not None
    noise = F.array(*[X.uniform(seed + i, "id") - 0.5 for i in range(width)])
    if not known:
        begun = nodes.select("id", F.struct(noise.alias("f")).alias("v"))
    else:
        begun = nodes.select("id").join(null.select("id", "label", "c"), "id", "left").select("id", F.struct(noise.alias("f"), "label", "c").alias("v"))

    def first(q, fixed, ids, v):
        order = np.argsort(ids)
        v = v.combine_chunks()
        x = v.field("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]
        if not known:
            return (x, x), fixed.sent(x)
        real = np.asarray(v.field("label").is_valid())[order]
        label, c = (v.field(name).fill_null(0).to_numpy(zero_copy_only=False)[order] for name in ("label", "c"))
        labels, place = np.unique(label[real], return_inverse=True)
        where = np.full(len(x), -1)
        where[real] = place
        fixed.null = labels, where, c, labels % count
        return (x, x), _parts(fixed.null, x)

    def ended(state):
        """From the last vectors of a filter: without their null part, with their product, written."""
        if known:
            state = B.exchanged(B.exchanged(state, count, _totals), count, _cleared)
        return cut(B.exchanged(state, count, lambda q, fixed, held, inbox: ((held[1], fixed.product(fixed.seen(held[1], inbox), piece)), [])))

    state = ended(B.packed(begun, op, count, first))
    for _ in range(rounds):
        # Rotated twice, for one rotation leaves what the conditioning of the columns takes away.
        turn = _even(_gram(state, width, np.eye(width), count > PARTIALS)[:width, :width])
        g = _gram(state, width, turn, count > PARTIALS)
        again = _even(g[:width, :width])
        xx, xs, ss = (again.T @ m @ again for m in (g[:width, :width], (g[:width, width:] + g[width:, :width]) / 2, g[width:, width:]))
        values, z = np.linalg.eigh(xs)
        values, z = values[::-1], z[:, ::-1]
        squares = np.einsum("ij,ik,kj->j", z, ss, z) - 2 * values * np.einsum("ij,ik,kj->j", z, xs, z) + values**2 * np.einsum("ij,ik,kj->j", z, xx, z)
        residuals = np.sqrt(np.maximum(squares, 0))
        scale, turn = max(abs(values[0]), abs(low), 1e-300), turn @ again @ z
        if residuals[:k].max() <= tolerance * scale:
            return Found(_unpacked(state, turn[:, :k]), values[:k], residuals[:k])
        top = max(values[-1], low + 1e-6 * (values[0] - low))
        centre, half = (top + low) / 2, (top - low) / 2

        def begin(q, fixed, held, _, turn=turn, centre=centre, half=half, last=degree == 1):
            a, s = held[0] @ turn, held[1] @ turn
            b = (s - centre * a) / half
            return (a, b), sent(fixed, b, last)

        def onward(last, centre=centre, half=half):
            def step(q, fixed, held, inbox):
                a, b = held
                new = 2 / half * (fixed.product(fixed.seen(b, inbox), piece) - centre * b) - a
                return (b, new), sent(fixed, new, last)

            return step

        def sent(fixed, b, last):
            return _parts(fixed.null, b) if last and known else fixed.sent(b)

        before, state = state, B.local(state, begin)
        for i in range(1, degree):
            state = B.exchanged(state, count, onward(i == degree - 1))
        state = ended(state)
        dropped(before)
    raise ValueError(f"residuals of {residuals[:k].max():.1e} after {rounds} rounds")


def _unpacked(state: DataFrame, turn: np.ndarray) -> DataFrame:
    """(id, f): the blocks' x times ``turn``."""

    def rows(fixed, held):
        x = np.ascontiguousarray(held[0] @ turn)
        ends = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(fixed.ids), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "f"])

    return B.over(state, rows, "id long, f array<double>")


def _signed(found: Found, k: int) -> Found:
    return Found(FT.sign_rule(cut(found.vectors), k), found.values, found.residuals)


def _symmetric(e: DataFrame) -> DataFrame:
    """The larger of an edge's two weights, both ways."""
    both = e.select("src", "dst", "w").union(G.flipped(e.select("src", "dst", "w")))
    return both.groupBy("src", "dst").agg(F.max("w").cast("double").alias("w"))


def laplacian_positions(e: DataFrame, nodes: DataFrame, k: int = 16, tolerance: float = 1e-6) -> Found:
    """Eigenvectors of the k smallest non-zero eigenvalues of the symmetric normalised Laplacian, smallest first.

    The null vectors are known, sqrt(degree) on each component, and are left out; nodes without edges have
    the value 1. The entry of largest size of each vector is positive.
    """
    a = cut(_symmetric(e))
    degree = a.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    root = cut(degree.select("id", F.sqrt("d").alias("r")))
    op = a.join(root.select(F.col("id").alias("src"), F.col("r").alias("rs")), "src").join(root.select(F.col("id").alias("dst"), F.col("r").alias("rd")), "dst")
    op = op.select("src", "dst", (F.col("w") / (F.col("rs") * F.col("rd"))).alias("w"))
    labels = components(a, root.select("id")).join(root, "id")
    size = labels.groupBy("label").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("size"))
    null = cut(labels.join(size, "label").select("id", "label", (F.col("r") / F.col("size")).alias("c")))
    found = _signed(largest(op, nodes, k, -1.0, null, tolerance), k)
    return Found(found.vectors, 1 - found.values, found.residuals)


def laplacian_svd(e: DataFrame, nodes: DataFrame, k: int = 100, tolerance: float = 1e-6) -> Found:
    """The k largest singular triplets of the raw Laplacian D - A of an undirected graph: its vectors, and as
    values the root of the explained variance of the projections."""
    a = _symmetric(G.drop_loops(e))
    degree = a.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    op = cut(a.select("src", "dst", (-F.col("w")).alias("w")).union(degree.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("d").alias("w"))))
    n = nodes.count()
    found = _signed(largest(op, nodes, min(k, n - 1), 0.0, None, tolerance), min(k, n - 1))
    f = F.col("f")
    mean = np.array(found.vectors.agg(F.array(*[F.avg(f[i]) for i in range(len(found.values))]).alias("m")).first()["m"])
    return Found(found.vectors, found.values * np.sqrt(np.maximum(1 / n - mean**2, 0)), found.residuals)
