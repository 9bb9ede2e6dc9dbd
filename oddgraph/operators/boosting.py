"""Boosted trees over binned features, with dropped and rescaled trees, trained by histograms.

Features are cut into bins once, at quantiles, and packed into blocks of one byte a value. A level of a tree
is one narrow pass: each task sums gradients and curvatures by tree node, feature and bin, the sums are
added up in two steps, and the driver picks the splits, so what reaches it is nodes x features x bins
numbers, however many rows there are. The margin of a row is kept with its block and brought up to date
after each tree.

Dropping (dart): before a tree is fitted each earlier one is left out with a given probability; the new tree
is fitted to the rest's gradients, and weights are rescaled so that the dropped trees and the new one
together weigh what the dropped ones did. Without dropping this is plain boosting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.operators.propagate import cut

#: Bins of a feature at most, rows of a block, partial histograms that the driver adds up itself.
BINS, BLOCK, PARTIALS = 64, 8192, 64
#: Trees after which margins are written to the shared folder instead of following from the tree before.
KEEP = 10


@dataclass(frozen=True)
class Settings:
    """The usual settings of the boosted baseline; depth and least curvature are the method's defaults."""

    trees: int = 50
    rate: float = 0.05
    shrink: float = 10.0
    share: float = 0.5
    depth: int = 6
    least: float = 1.0
    drop: float = 0.0
    skip: float = 0.0


@dataclass
class Tree:
    """Nodes in level order from 1: inner nodes have a feature, rows of bin <= cut go to 2k, others to 2k + 1."""

    feature: dict[int, int]
    cut: dict[int, int]
    value: dict[int, float]

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row, as far down as the tree goes."""
        at = np.ones(len(bins), np.int64)
        for k in sorted(self.feature):
            here = np.flatnonzero(at == k)
            at[here] = 2 * k + (bins[here, self.feature[k]] > self.cut[k])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        at = self.place(bins)
        nodes, where = np.unique(at, return_inverse=True)
        return np.array([self.value[int(k)] for k in nodes])[where]


@dataclass
class Forest:
    cuts: list[np.ndarray]
    trees: list[Tree]
    weights: list[float]
    losses: list[float]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1).astype(np.uint8) if len(x) else np.zeros((0, len(self.cuts)), np.uint8)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return sum((w * t.values(bins) for t, w in zip(self.trees, self.weights)), np.zeros(len(bins)))


def quantile_cuts(nodes: DataFrame, width: int, bins: int = BINS, error: float = 0.001) -> list[np.ndarray]:
    """Distinct inner quantiles of each column of f, by a distributed sketch."""
    flat = nodes.select(*[F.col("f")[j].alias(f"c{j}") for j in range(width)])
    found = flat.approxQuantile([f"c{j}" for j in range(width)], [k / bins for k in range(1, bins)], error)
    return [np.unique(np.array(c, float)) for c in found]


def _uniform(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) from row id and tree, the same in every partition."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree + 1) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return h.astype(float) / 2.0**64


_NAMES = ["ids", "bins", "y", "w", "margin"]
_SCHEMA = "ids binary, bins binary, y binary, w binary, margin binary"


def _row(ids, bins, y, w, margin) -> pa.RecordBatch:
    kinds = (np.int64, np.uint8, np.float64, np.float64, np.float64)
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, k).tobytes()], pa.binary()) for x, k in zip((ids, bins, y, w, margin), kinds)], _NAMES)


def _read(batch: pa.RecordBatch, width: int):
    for r in batch.to_pylist():
        yield np.frombuffer(r["ids"], np.int64), np.frombuffer(r["bins"], np.uint8).reshape(-1, width), *(np.frombuffer(r[c], float) for c in _NAMES[2:])


def _packed(nodes: DataFrame, forest: Forest, positive: float) -> DataFrame:
    """Blocks of labelled nodes(id, f, y): binned features, labels, weights (normals 1) and margins 0."""

    def pack(batches):
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                x = part["f"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
                y = part["y"].to_numpy(zero_copy_only=False).astype(float)
                yield _row(part["id"].to_numpy(), forest.binned(x), y, np.where(y == 1, positive, 1.0), np.zeros(len(y)))

    return nodes.where("y in (0, 1)").select("id", "f", F.col("y").cast("int").alias("y")).mapInArrow(pack, _SCHEMA)


def _added(blocks: DataFrame, many: bool, f) -> np.ndarray:
    """The sum over blocks of the vectors f(block) gives."""

    def rows(v):
        if v is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], ["v"])

    def part(batches):
        v = None
        for batch in batches:
            for x in f(batch):
                v = x if v is None else v + x
        yield from rows(v)

    def merge(batches):
        v = None
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["v"], float)
                v = x if v is None else v + x
        yield from rows(v)

    partial = blocks.mapInArrow(part, "v binary")
    if many:
        partial = partial.repartition(PARTIALS).mapInArrow(merge, "v binary")
    found = [np.frombuffer(r["v"], float) for r in partial.collect()]
    return np.sum(found, axis=0)


def _fit_tree(blocks: DataFrame, many: bool, forest: Forest, dropped: list[int], s: Settings, seed: int, tree: int) -> tuple[Tree, float]:
    """One tree, level by level, against the margins without the dropped trees; and the loss before it."""
    width, bins = len(forest.cuts), max(len(c) for c in forest.cuts) + 1
    out, live = Tree({}, {}, {}), [1]
    gone = [(forest.trees[k], forest.weights[k]) for k in dropped]
    loss = 0.0

    for level in range(s.depth + 1):
        number = {k: i for i, k in enumerate(live)}

        def sums(batch, out=out, number=number, level=level):
            for ids, b, y, w, margin in _read(batch, width):
                margin = margin - sum((weight * t.values(b) for t, weight in gone), np.zeros(len(b)))
                p = 1 / (1 + np.exp(-margin))
                g, h = w * (p - y), w * p * (1 - p)
                mean = float((w * np.logaddexp(0, np.where(y == 1, -margin, margin))).sum()), float(w.sum())
                g, h = (np.where(_uniform(ids, seed, tree) < s.share, v, 0.0) for v in (g, h))
                at = out.place(b)
                slot = np.array([number.get(int(k), -1) for k in range(2 ** (level + 1))])[at]
                rows = np.flatnonzero(slot >= 0)
                v = np.zeros((2, len(number), width, bins))
                for j in range(width):
                    where = slot[rows] * bins + b[rows, j]
                    for side, weights in enumerate((g, h)):
                        v[side, :, j] = np.bincount(where, weights[rows], len(number) * bins).reshape(-1, bins)
                yield np.concatenate([v.ravel(), mean])

        found = _added(blocks, many, sums)
        if level == 0:
            loss = found[-2] / found[-1]
        g, h = found[:-2].reshape(2, len(live), width, bins)
        deeper = []
        for i, k in enumerate(live):
            total_g, total_h = g[i, 0].sum(), h[i, 0].sum()
            out.value[k] = -total_g / (total_h + s.shrink)
            if level == s.depth:
                continue
            left_g, left_h = np.cumsum(g[i], axis=1)[:, :-1], np.cumsum(h[i], axis=1)[:, :-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + s.shrink) + right_g**2 / (right_h + s.shrink) - total_g**2 / (total_h + s.shrink)
            gain = np.where((left_h >= s.least) & (right_h >= s.least), gain, -np.inf)
            if gain.size and gain.max() > 1e-9:
                j, c = np.unravel_index(int(gain.argmax()), gain.shape)
                out.feature[k], out.cut[k] = int(j), int(c)
                deeper += [2 * k, 2 * k + 1]
        live = deeper
        if not live:
            break
    return out, loss


def train(nodes: DataFrame, width: int, s: Settings = Settings(), seed: int = 0, bins: int = BINS) -> Forest:  # noqa: B008
    """Trees over nodes(id, f, y in 0, 1), other labels left out; anomalies together weigh as much as normals.

    Raises ValueError unless both classes are there.
    """
    n = {r["y"]: r["count"] for r in nodes.where("y in (0, 1)").groupBy("y").count().collect()}
    if len(n) < 2:
        raise ValueError("training needs normal and anomalous nodes")
    forest, rng = Forest(quantile_cuts(nodes.where("y in (0, 1)"), width, bins), [], [], []), np.random.default_rng(seed)
    blocks = _packed(nodes, forest, n[0] / n[1]).persist()
    many = blocks.rdd.getNumPartitions() > PARTIALS
    for t in range(s.trees):
        dropped = [] if rng.random() < s.skip else [k for k in range(t) if rng.random() < s.drop]
        tree, loss = _fit_tree(blocks, many, forest, dropped, s, seed, t)
        forest.losses.append(loss)
        # The new tree's weight, and how much each dropped one keeps.
        new, kept = s.rate / (len(dropped) + s.rate), len(dropped) / (len(dropped) + s.rate)
        changes = [(forest.trees[k], forest.weights[k] * (kept - 1)) for k in dropped]
        for k in dropped:
            forest.weights[k] *= kept
        forest.trees.append(tree)
        forest.weights.append(s.rate if not dropped else new)
        changes.append((tree, forest.weights[-1]))

        def moved(batches, changes=changes):
            for batch in batches:
                for ids, b, y, w, margin in _read(batch, width):
                    yield _row(ids, b, y, w, margin + sum(weight * c.values(b) for c, weight in changes))

        after = blocks.mapInArrow(moved, _SCHEMA)
        after = cut(after) if t % KEEP == KEEP - 1 else after.persist()
        after.count()
        blocks.unpersist()
        blocks = after
    blocks.unpersist()
    return forest


def scores(nodes: DataFrame, forest: Forest) -> DataFrame:
    """(id, score): P(anomaly) of nodes(id, f)."""

    def score(batches):
        for batch in batches:
            x = batch["f"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(forest.cuts)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(1 / (1 + np.exp(-forest.margins(forest.binned(x)))))], ["id", "score"])

    return nodes.select("id", "f").mapInArrow(score, "id long, score double")
