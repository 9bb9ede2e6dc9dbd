"""Node classifiers trained by full-batch gradients: a perceptron, graph convolution, graph attention.

What an epoch needs from the graph does not change, so it is gathered once by joins into packed blocks: a
block holds target nodes, the in-edges they depend on and the features at the edges' ends, as arrays. An
epoch is then one narrow pass over the blocks: each task computes loss and gradients of its blocks with
the parameters in its closure, partial sums are added up in two steps, and the driver, which holds the
parameters alone, takes an optimiser step. No epoch shuffles edges or features.

A node with more than ``hub`` in-edges is split into pieces that lie in different blocks. Sums and softmax
weights run over all pieces: an epoch first collects the pieces' partial results, a few numbers for each
such node (there are at most edges / hub of them), and the pieces' gradients use the totals.

Randomness (first parameters, dropped units) comes from seeds and node ids, not from partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Params = dict[str, np.ndarray]
#: In-edges from which a node is split, and targets of a block, about.
HUB, BLOCK = 1 << 16, 4096
#: Partial results that the driver adds up itself; more are added up by tasks before.
PARTIALS = 64


# ---- parts of networks, on arrays


def activation(name: str) -> tuple[Callable, Callable]:
    """The function and its derivative, both of the value before it."""
    known = {
        "relu": (lambda x: np.maximum(x, 0), lambda x: (x > 0).astype(float)),
        "leaky_relu": (lambda x: np.where(x > 0, x, 0.01 * x), lambda x: np.where(x > 0, 1.0, 0.01)),
        "elu": (lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), lambda x: np.where(x > 0, 1.0, np.exp(np.minimum(x, 0)))),
        "tanh": (np.tanh, lambda x: 1 - np.tanh(x) ** 2),
    }
    if name not in known:
        raise ValueError(f"unknown activation {name!r}")
    return known[name]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True)


def weighted_loss(z: np.ndarray, y: np.ndarray, positive: float) -> tuple[float, np.ndarray]:
    """Summed weighted cross-entropy of logits (rows of y < 0 don't count) and its gradient; normals weigh 1."""
    p, w = softmax(z), np.where(y < 0, 0.0, np.where(y == 1, positive, 1.0))
    at = np.arange(len(y)), np.maximum(y, 0)
    loss = float(-(w * np.log(np.maximum(p[at], 1e-300))).sum())
    p[at] -= 1
    return loss, p * w[:, None]


def kept_units(ids: np.ndarray, width: int, rate: float, seed: int, epoch: int) -> np.ndarray:
    """Dropout as a matrix of 0 and 1 / (1 - rate), a function of node, unit and epoch wherever the node is computed."""
    if not rate:
        return np.ones((len(ids), width))
    start = np.uint64((seed * 1_000_003 + epoch) % (1 << 64))
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + start
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return (h.astype(float) / 2.0**64 >= rate) / (1 - rate)


def _sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place, added in their order."""
    c = math.prod(rows.shape[1:])
    sums = np.bincount(_flat_places(at, c), np.ascontiguousarray(rows, float).ravel(), n * c)
    return sums.astype(float, copy=False).reshape(n, *rows.shape[1:])  # without rows they are integers


def _flat_places(at: np.ndarray, c: int) -> np.ndarray:
    """The places of rows of c entries in a flat array."""
    return (at[:, None] * c + np.arange(c)).ravel()


def _uniform(rng, shape: tuple, limit: float) -> np.ndarray:
    return rng.uniform(-limit, limit, shape)


# ---- optimiser


@dataclass
class Adam:
    """Adam with the decay added to the gradient."""

    rate: float
    decay: float = 0.0
    step: int = 0
    first: Params = field(default_factory=dict)
    second: Params = field(default_factory=dict)

    def __call__(self, params: Params, grads: Params) -> Params:
        self.step += 1
        out = {}
        for k, p in params.items():
            g = grads[k] + self.decay * p
            self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * g * g
            m, v = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.999**self.step)
            out[k] = p - self.rate * m / (np.sqrt(v) + 1e-8)
        return out


# ---- blocks


def _bytes(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


# Arrays of a block. Targets: ids, y (below 0 where no label counts), own (1 but for further pieces of a split
# target), cut (1 for split targets). Edge k leads from node src[k] to target dst[k] with weight w[k]; the nodes
# are node_ids with features x. With a second layer, far edges lead from far node src2[k] to node dst2[k], and x
# belongs to far_ids; node_cut is 1 for nodes whose far edges lie in blocks of their own.
_ARRAYS = {
    "ids": np.int64, "y": np.int64, "own": np.int64, "cut": np.int64, "src": np.int64, "dst": np.int64, "w": np.float64, "node_ids": np.int64,
    "node_cut": np.int64, "src2": np.int64, "dst2": np.int64, "far_ids": np.int64, "x": np.float64,
}
_SCHEMA = ", ".join(f"{k} binary" for k in _ARRAYS) + ", width int, split boolean"


class Block:
    """The arrays of a block as attributes; absent ones are empty."""

    def __init__(self, width: int, **arrays: np.ndarray):
        for k, kind in _ARRAYS.items():
            setattr(self, k, arrays.get(k, np.empty(0, kind)))
        self.x = self.x.reshape(-1, width)
        if len(self.own) != len(self.ids):
            self.own, self.cut = np.ones(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)

    def row(self) -> pa.Table:
        found = {k: pa.array([_bytes(getattr(self, k), kind)], pa.binary()) for k, kind in _ARRAYS.items()}
        return pa.table({**found, "width": pa.array([self.x.shape[1]], pa.int32()), "split": pa.array([bool(self.cut.any())])})


def _read(batch: pa.RecordBatch) -> Iterable[Block]:
    for row in batch.to_pylist():
        yield Block(row["width"], **{k: np.frombuffer(row[k], kind) for k, kind in _ARRAYS.items()})


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


class Blocks:
    """Packed blocks, kept by the executors during training; a lost one is packed anew from its tables."""

    def __init__(self, df: DataFrame, hubs: DataFrame | None = None):
        self.df, self.hubs = df, hubs

    def __enter__(self):
        packed = self.df.persist()
        count = packed.count()
        if count < packed.rdd.getNumPartitions():  # a pass starts no tasks without a block
            self.df = packed.repartitionByRange(max(1, count), F.xxhash64("ids", "src")).persist()
            self.df.count()
            packed.unpersist()
        else:
            self.df = packed
        self.hubs = self.hubs.persist() if self.hubs is not None else None
        return self

    def __exit__(self, *_):
        for x in (self.df, self.hubs):
            if x is not None:
                x.unpersist()

    @cached_property
    def many(self) -> bool:
        return self.df.rdd.getNumPartitions() > PARTIALS

    @cached_property
    def split(self) -> DataFrame | None:
        """The blocks with split targets, if there are any."""
        found = self.df.where("split")
        return None if found.isEmpty() else found

    @cached_property
    def split_nodes(self) -> DataFrame | None:
        """The blocks of split nodes' far edges, if there are any."""
        return None if self.hubs is None or self.hubs.isEmpty() else self.hubs


def node_blocks(nodes: DataFrame, width: int, size: int = BLOCK) -> Blocks:
    """Blocks of nodes(id, f, y) without edges; a null y does not count."""

    def pack(batches):
        for batch in batches:
            for a in range(0, len(batch), size):
                part = batch.slice(a, size)
                y = part["y"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield from Block(width, ids=part["id"].to_numpy(), y=y, x=_matrix(part["f"], width)).row().to_batches()

    dealt = nodes.select("id", "f", F.col("y").cast("int").alias("y")).repartition(max(1, math.ceil(nodes.count() / size)), "id")
    return Blocks(dealt.mapInArrow(pack, _SCHEMA))


def _pass(blocks: DataFrame, many: bool, f: Callable[[Block], Iterable[tuple[int, np.ndarray]]], merged: Callable = np.add) -> dict[int, np.ndarray]:
    """f gives (key, vector) pairs of a block; each key's vectors of all blocks, merged (summed, unless told otherwise)."""
    names, schema = ["key", "v"], "key long, v binary"

    def add(held: dict, key: int, v: np.ndarray) -> None:
        held[key] = merged(held[key], v) if key in held else v

    def rows(held: dict):
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([_bytes(v, float) for v in held.values()], pa.binary())], names)

    def part(batches):
        held: dict = {}
        for batch in batches:
            for block in _read(batch):
                for key, v in f(block):
                    add(held, int(key), v)
        yield from rows(held)

    def merge(batches):
        held: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                add(held, row["key"], np.frombuffer(row["v"], float))
        yield from rows(held)

    partial = blocks.mapInArrow(part, schema)
    if many:
        partial = partial.repartition(PARTIALS).mapInArrow(merge, schema)
    out: dict = {}
    for row in partial.collect():
        add(out, row["key"], np.frombuffer(row["v"], float))
    return out


def _flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def _unflat(v: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


# ---- training


@dataclass
class Trained:
    params: Params
    losses: list[float]


class Network:
    """What the networks share: loss, gradient, training and scores over blocks."""

    def first(self, width: int, seed: int) -> Params:
        raise NotImplementedError

    def logits(self, block: Block, params: Params, totals: dict, epoch: int) -> np.ndarray:
        raise NotImplementedError

    def gradient(self, block: Block, params: Params, positive: float, totals: dict, epoch: int) -> tuple[float, Params, dict]:
        """Loss, gradients, and gradients of split nodes' totals by node."""
        raise NotImplementedError

    def totals(self, blocks: Blocks, params: Params, epoch: int) -> dict:
        """What split targets and nodes add up to over all pieces."""
        return {}

    def through(self, blocks: Blocks, params: Params, totals: dict, backward: dict) -> np.ndarray | float:
        """What the gradients of split nodes' totals add to the gradients."""
        return 0.0

    def weights(self, blocks: Blocks) -> tuple[float, float]:
        """(weight of an anomaly, summed weight): normals weigh 1, anomalies as much as all normals."""
        n = _pass(blocks.df, blocks.many, lambda b: [(0, np.array([((b.y == c) & (b.own > 0)).sum() for c in (0, 1)], float))]).get(0, np.zeros(2))
        if not n.all():
            raise ValueError("training needs normal and anomalous nodes")
        return n[0] / n[1], 2 * n[0]

    def loss_and_gradient(self, blocks: Blocks, params: Params, epoch: int = -1, weights: tuple[float, float] | None = None) -> tuple[float, Params]:
        """Weighted mean loss over all labelled targets and its gradient; epoch -1 drops no units."""
        positive, total = weights or self.weights(blocks)
        totals = self.totals(blocks, params, epoch)

        def one(block):
            loss, grads, back = self.gradient(block, params, positive, totals, epoch)
            return [(-1, np.append(_flat(grads), loss)), *back.items()]

        found = _pass(blocks.df, blocks.many, one)
        v = found.pop(-1)
        grads = v[:-1] + self.through(blocks, params, totals, found)
        return float(v[-1] / total), _unflat(grads / total, params)

    def train(self, blocks: Blocks, width: int, epochs: int, rate: float, decay: float = 0.0, seed: int = 0) -> Trained:
        with blocks:
            params, step, losses, weights = self.first(width, seed), Adam(rate, decay), [], self.weights(blocks)
            for epoch in range(epochs):
                loss, grads = self.loss_and_gradient(blocks, params, epoch, weights)
                params = step(params, grads)
                losses.append(loss)
        return Trained(params, losses)

    def scores(self, blocks: Blocks, params: Params) -> DataFrame:
        """(id, score): P(anomaly) of every target."""
        totals = self.totals(blocks, params, -1)

        def score(batches):
            for batch in batches:
                for block in _read(batch):
                    p, mine = softmax(self.logits(block, params, totals, -1))[:, 1], block.own > 0
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[mine]), pa.array(p[mine])], ["id", "score"])

        return blocks.df.mapInArrow(score, "id long, score double")


# ---- perceptron


@dataclass
class Perceptron(Network):
    """``layers`` hidden layers and a linear classifier over a node's own features."""

    hidden: int = 32
    layers: int = 2
    act: str = "leaky_relu"

    def first(self, width, seed):
        rng, out = np.random.default_rng(seed), {}
        for k in range(self.layers + 1):
            to = 2 if k == self.layers else self.hidden
            out[f"w{k}"], out[f"b{k}"] = _uniform(rng, (width, to), width**-0.5), _uniform(rng, (to,), width**-0.5)
            width = to
        return out

    def _forward(self, x: np.ndarray, params: Params) -> list[tuple[np.ndarray, np.ndarray]]:
        """(input, value before the activation) of each layer."""
        f, _ = activation(self.act)
        seen = []
        for k in range(self.layers + 1):
            z = x @ params[f"w{k}"] + params[f"b{k}"]
            seen.append((x, z))
            x = f(z)
        return seen

    def logits(self, block, params, totals, epoch):
        return self._forward(block.x, params)[-1][1]

    def gradient(self, block, params, positive, totals, epoch):
        _, slope = activation(self.act)
        seen, grads = self._forward(block.x, params), {}
        loss, d = weighted_loss(seen[-1][1], block.y, positive)
        for k in reversed(range(self.layers + 1)):
            grads[f"w{k}"], grads[f"b{k}"] = seen[k][0].T @ d, d.sum(axis=0)
            if k:
                d = (d @ params[f"w{k}"].T) * slope(seen[k - 1][1])
        return loss, grads, {}


# ---- dealing edges into blocks


def _dealt(e: DataFrame, nodes: DataFrame, hub: int, size: int) -> DataFrame:
    """In-edges of targets nodes(id, y) with their block: (block, src, dst, w, y, own, cut), with an edge of null
    src for targets, and first pieces, that have none. e(src, dst, w). About ``size`` targets or ``hub`` edges a block."""
    k = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
    targets = nodes.select("id", F.coalesce(F.col("y").cast("int"), F.lit(-1)).alias("y")).join(k, "id", "left").na.fill(0, ["k"])
    total = targets.agg(F.count("*").alias("n"), F.sum(F.least("k", F.lit(hub))).alias("k")).first()
    count = max(1, math.ceil(total["n"] / size), math.ceil((total["k"] or 0) / hub))
    dealt = targets.select(F.col("id").alias("dst"), "y", F.greatest(F.ceil(F.col("k") / hub), F.lit(1)).alias("pieces"))
    home = F.pmod(F.xxhash64("dst"), F.lit(count))
    piece = F.when((F.col("pieces") > 1) & (F.col("src") != F.col("dst")), F.pmod(F.xxhash64("src"), F.col("pieces"))).otherwise(F.lit(0))
    cut = (F.col("pieces") > 1).cast("long").alias("cut")
    # A first piece lies in the target's block, the others in blocks of their own.
    block = F.when(piece == 0, home).otherwise(count + F.pmod(F.xxhash64("dst", piece), F.lit(1 << 40)))
    rows = e.select("src", "dst", "w").join(dealt, "dst").select(block.alias("block"), "src", "dst", "w", "y", (piece == 0).cast("long").alias("own"), cut)
    every = dealt.select(home.alias("block"), F.lit(None).cast("long").alias("src"), "dst", F.lit(0.0).alias("w"), "y", F.lit(1).cast("long").alias("own"), cut)
    return rows.union(every)


def _targets(group: pa.Table) -> tuple[dict[str, np.ndarray], pa.Table, np.ndarray]:
    """Targets' arrays of a group of dealt edges, its real edges, and these edges' targets."""
    ids, first, at = np.unique(group["dst"].to_numpy(), return_index=True, return_inverse=True)
    real = np.asarray(group["src"].is_valid())
    return {"ids": ids, **{k: group[k].to_numpy()[first].astype(np.int64) for k in ("y", "own", "cut")}}, group.filter(pa.array(real)), at[real]


# ---- graph convolution


def convolution_blocks(e: DataFrame, x: DataFrame, nodes: DataFrame, width: int, hub: int = HUB, size: int = BLOCK) -> Blocks:
    """Blocks of targets nodes(id, y), their in-edges e(src, dst, w) and the features x(id, f) of the sources.
    Targets without in-edges are targets all the same."""
    rows = _dealt(e, nodes, hub, size).join(x.select(F.col("id").alias("src"), "f"), "src", "left")

    def pack(group: pa.Table) -> pa.Table:
        targets, edges, dst = _targets(group)
        sources, first, src = np.unique(edges["src"].to_numpy(), return_index=True, return_inverse=True)
        return Block(width, **targets, src=src, dst=dst, w=edges["w"].to_numpy(), node_ids=sources, x=_matrix(edges["f"].take(pa.array(first)), width)).row()

    return Blocks(rows.groupBy("block").applyInArrow(pack, _SCHEMA))


@dataclass
class Convolution(Network):
    """Two layers A act(A X W0 + b0) W1 + b1 over a normalised A. The product of A with the fixed X is made
    once, as a distributed sparse product, and is what the blocks hold."""

    hidden: int = 64
    act: str = "relu"
    dropout: float = 0.0
    seed: int = 0

    def first(self, width, seed):
        rng = np.random.default_rng(seed)
        w = {f"w{k}": _uniform(rng, shape, (6 / sum(shape)) ** 0.5) for k, shape in enumerate(((width, self.hidden), (self.hidden, 2)))}
        return {**w, "b0": np.zeros(self.hidden), "b1": np.zeros(2)}

    def _forward(self, block: Block, params: Params, epoch: int):
        """Hidden values before the activation, after it, the dropout, and the targets' sums over this block's edges."""
        z = block.x @ params["w0"] + params["b0"]
        mask = kept_units(block.node_ids, self.hidden, self.dropout if epoch >= 0 else 0.0, self.seed, epoch)
        h = activation(self.act)[0](z) * mask
        return z, h, mask, _sums(block.w[:, None] * (h @ params["w1"])[block.src], block.dst, len(block.ids))

    def totals(self, blocks, params, epoch):
        def partial(block):
            at = np.flatnonzero(block.cut)
            return zip(block.ids[at].tolist(), self._forward(block, params, epoch)[3][at])

        return _pass(blocks.split, blocks.many, partial) if blocks.split is not None else {}

    def _whole(self, block: Block, sums: np.ndarray, totals: dict) -> np.ndarray:
        for i in np.flatnonzero(block.cut):
            sums[i] = totals[int(block.ids[i])]
        return sums

    def logits(self, block, params, totals, epoch):
        return self._whole(block, self._forward(block, params, epoch)[3], totals) + params["b1"]

    def gradient(self, block, params, positive, totals, epoch):
        z, h, mask, sums = self._forward(block, params, epoch)
        out = self._whole(block, sums, totals) + params["b1"]
        mine = block.own > 0
        _, d = weighted_loss(out, block.y, positive)
        loss, _ = weighted_loss(out[mine], block.y[mine], positive)
        back = _sums(block.w[:, None] * d[block.dst], block.src, len(block.x))
        dz = (back @ params["w1"].T) * mask * activation(self.act)[1](z)
        return loss, {"w1": h.T @ back, "b1": d[mine].sum(axis=0), "w0": block.x.T @ dz, "b0": dz.sum(axis=0)}, {}


# ---- graph attention


def attention_blocks(e: DataFrame, x: DataFrame, nodes: DataFrame, width: int, hub: int = HUB, size: int = BLOCK) -> Blocks:
    """Blocks of targets nodes(id, y) with the edges of the two hops before them and the far ends' features x(id, f).

    e(src, dst) is distinct and holds the loop of every node, for attention reads a node's own values too. Far edges
    of split nodes lie in blocks of their own, a piece each, as edges to their one target.
    """
    e = e.select("src", "dst", F.lit(1.0).alias("w"))
    k = e.groupBy("dst").agg(F.count("*").alias("k"))
    cut = k.where(F.col("k") > hub).select(F.col("dst").alias("id"), F.lit(1).cast("long").alias("node_cut"))
    near = _dealt(e, nodes, hub, size)
    within = near.where("src is not null").select("block", F.col("src").alias("id")).union(near.select("block", F.col("dst").alias("id"))).distinct().join(cut, "id", "left").na.fill(0, ["node_cut"])
    far = within.where("node_cut = 0").select("block", F.col("id").alias("dst")).join(e.select("src", "dst"), "dst")
    ends = far.select("block", F.col("src").alias("id")).distinct().join(x.select("id", "f"), "id")
    none, no_f = (lambda kind: F.lit(None).cast(kind)), F.lit(None).cast("array<double>").alias("f")
    shape = lambda df, kind, **c: df.select("block", F.lit(kind).alias("kind"), *[c.get(n, none("long")).alias(n) for n in ("src", "dst", "y", "own", "cut")], c.get("f", no_f).alias("f"))
    col = F.col
    rows = shape(near, 0, src=col("src"), dst=col("dst"), y=col("y").cast("long"), own=col("own"), cut=col("cut"))
    rows = rows.union(shape(within, 1, dst=col("id"), cut=col("node_cut"))).union(shape(far, 2, src=col("src"), dst=col("dst"))).union(shape(ends, 3, src=col("id"), f=col("f")))

    def pack(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        part = [group.filter(pa.array(kind == k)) for k in range(4)]
        targets, edges, dst = _targets(part[0])
        node_ids, at = np.unique(part[1]["dst"].to_numpy(), return_index=True)
        far_ids, where = np.unique(part[3]["src"].to_numpy(), return_index=True)
        place = lambda ids, c: np.searchsorted(ids, c.to_numpy())
        return Block(
            width, **targets, src=place(node_ids, edges["src"]), dst=dst, w=np.ones(len(dst)), node_ids=node_ids, node_cut=part[1]["cut"].to_numpy()[at],
            src2=place(far_ids, part[2]["src"]), dst2=place(node_ids, part[2]["dst"]), far_ids=far_ids, x=_matrix(part[3]["f"].take(pa.array(where)), width),
        ).row()

    # Pieces of split nodes: edges to the one target, whose own features go along with each piece.
    pieces = F.ceil(F.col("k") / hub)
    mine = e.join(k.where(F.col("k") > hub), "dst").select("src", "dst", F.pmod(F.xxhash64("src"), pieces).alias("piece"))
    loops = mine.select(F.col("dst").alias("src"), "dst", "piece").distinct()
    mine = mine.withColumn("real", F.lit(1)).union(loops.withColumn("real", F.lit(0))).join(x.select(F.col("id").alias("src"), "f"), "src")

    def pack_piece(group: pa.Table) -> pa.Table:
        ids, first = np.unique(group["src"].to_numpy(), return_index=True)
        node = group["dst"][0].as_py()
        real = np.unique(group.filter(pa.array(group["real"].to_numpy() == 1))["src"].to_numpy())
        return Block(width, ids=np.array([node]), y=np.array([-1]), src=np.searchsorted(ids, real), dst=np.zeros(len(real), np.int64), node_ids=ids, x=_matrix(group["f"].take(pa.array(first)), width)).row()

    return Blocks(rows.groupBy("block").applyInArrow(pack, _SCHEMA), mine.groupBy("dst", "piece").applyInArrow(pack_piece, _SCHEMA))


class _Heads:
    """One attention layer over an edge list: softmax over a target's in-edges of leaky(a_s . h_src + a_d . h_dst), a head each."""

    slope = 0.2

    def __init__(self, h: np.ndarray, own: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int, to_src: np.ndarray, to_dst: np.ndarray):
        self.h, self.own, self.src, self.dst, self.n, self.to_src, self.to_dst = h, own, src, dst, n, to_src, to_dst
        self.raw = np.einsum("ekd,kd->ek", h[src], to_src) + np.einsum("nkd,kd->nk", own, to_dst)[dst]
        self.e = np.where(self.raw > 0, self.raw, self.slope * self.raw)

    def partial(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest logit, sum of weights shifted by it, weighted sum of h, of each target."""
        top = np.full((self.n, self.h.shape[1]), -np.inf)
        np.maximum.at(top.reshape(-1), _flat_places(self.dst, self.h.shape[1]), self.e.ravel())
        p = np.exp(self.e - top[self.dst])
        return top, _sums(p, self.dst, self.n), _sums(p[:, :, None] * self.h[self.src], self.dst, self.n)

    def backward(self, d: np.ndarray, top: np.ndarray, total: np.ndarray, mean: np.ndarray):
        """Gradients of h, own, to_src and to_dst from those of the targets' means; totals may be over more edges than these."""
        share = np.exp(self.e - top[self.dst]) / total[self.dst]
        de = share * (np.einsum("ekd,ekd->ek", d[self.dst], self.h[self.src]) - np.einsum("nkd,nkd->nk", d, mean)[self.dst])
        de = de * np.where(self.raw > 0, 1.0, self.slope)
        from_src, from_dst = _sums(de, self.src, len(self.h)), _sums(de, self.dst, self.n)
        dh = _sums(share[:, :, None] * d[self.dst], self.src, len(self.h)) + from_src[:, :, None] * self.to_src
        return dh, from_dst[:, :, None] * self.to_dst, np.einsum("nk,nkd->kd", from_src, self.h), np.einsum("nk,nkd->kd", from_dst, self.own)


def _joined(a: np.ndarray, b: np.ndarray, heads: int, width: int) -> np.ndarray:
    """Two partial results of a split node, (top, sum, weighted sum) in a row, as one."""
    (ta, sa, va), (tb, sb, vb) = (_parted(x, heads, width) for x in (a, b))
    top = np.maximum(ta, tb)
    fa, fb = np.exp(ta - top), np.exp(tb - top)
    return np.concatenate([top, sa * fa + sb * fb, (va * fa[:, None] + vb * fb[:, None]).ravel()])


def _parted(x: np.ndarray, heads: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x[:heads], x[heads : 2 * heads], x[2 * heads :].reshape(heads, width)


@dataclass
class Attention(Network):
    """Two attention layers: ``heads`` heads side by side, an activation, one head of two classes."""

    hidden: int = 8
    heads: int = 8
    act: str = "elu"

    def first(self, width, seed):
        rng, k, d = np.random.default_rng(seed), self.heads, self.hidden
        limit = lambda *shape: _uniform(rng, shape, (6 / (shape[-1] + shape[-2])) ** 0.5)
        return {"w0": limit(width, k * d), "s0": limit(k, d), "d0": limit(k, d), "b0": np.zeros(k * d), "w1": limit(k * d, 2), "s1": limit(1, 2), "d1": limit(1, 2), "b1": np.zeros(2)}

    def _first_layer(self, block: Block, params: Params) -> _Heads:
        """Of a block of far edges, or of a split node's piece."""
        h = (block.x @ params["w0"]).reshape(-1, self.heads, self.hidden)
        at, src, dst = self._ends(block)
        own = h[at] if len(h) else np.zeros((len(at), self.heads, self.hidden))
        return _Heads(h, own, src, dst, len(at), params["s0"], params["d0"])

    @staticmethod
    def _ends(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the first layer's own features, and its edges. Split nodes have no features and no edges here: any place does."""
        if len(block.node_cut):
            return np.minimum(np.searchsorted(block.far_ids, block.node_ids), max(len(block.far_ids) - 1, 0)), block.src2, block.dst2
        return np.searchsorted(block.node_ids, block.ids), block.src, block.dst

    def _forward(self, block: Block, params: Params, totals: dict) -> dict:
        one = self._first_layer(block, params)
        top, total, summed = one.partial()
        for i in np.flatnonzero(block.node_cut):
            top[i], total[i], summed[i] = _parted(totals["nodes"][int(block.node_ids[i])], self.heads, self.hidden)
        mean = summed / total[:, :, None]
        z = mean.reshape(len(mean), -1) + params["b0"]
        h = activation(self.act)[0](z)
        h2 = (h @ params["w1"])[:, None, :]
        two = _Heads(h2, h2[np.searchsorted(block.node_ids, block.ids)], block.src, block.dst, len(block.ids), params["s1"], params["d1"])
        return {"one": one, "first": (top, total, mean), "z": z, "h": h, "two": two, "second": two.partial()}

    def totals(self, blocks, params, epoch):
        if blocks.split_nodes is None:
            return {}

        def nodes(block):
            top, total, summed = self._first_layer(block, params).partial()
            return [(block.ids[0], np.concatenate([top[0], total[0], summed[0].ravel()]))]

        found = {"nodes": _pass(blocks.split_nodes, blocks.many, nodes, lambda a, b: _joined(a, b, self.heads, self.hidden)), "targets": {}}

        def targets(block):
            top, total, summed = self._forward(block, params, found)["second"]
            return [(block.ids[i], np.concatenate([top[i], total[i], summed[i].ravel()])) for i in np.flatnonzero(block.cut) if total[i] > 0]

        if blocks.split is not None:
            found["targets"] = _pass(blocks.split, blocks.many, targets, lambda a, b: _joined(a, b, 1, 2))
        return found

    def _means(self, block: Block, seen: dict, totals: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top, total, summed = seen["second"]
        for i in np.flatnonzero(block.cut):
            top[i], total[i], summed[i] = _parted(totals["targets"][int(block.ids[i])], 1, 2)
        return top, total, summed / total[:, :, None]

    def logits(self, block, params, totals, epoch):
        return self._means(block, self._forward(block, params, totals), totals)[2][:, 0] + params["b1"]

    def gradient(self, block, params, positive, totals, epoch):
        seen = self._forward(block, params, totals)
        top, total, mean = self._means(block, seen, totals)
        out, mine = mean[:, 0] + params["b1"], block.own > 0
        _, d = weighted_loss(out, block.y, positive)
        loss, _ = weighted_loss(out[mine], block.y[mine], positive)
        dh2, down, ds1, dd1 = seen["two"].backward(d[:, None, :], top, total, mean)
        dh2 = (dh2 + _sums(down, np.searchsorted(block.node_ids, block.ids), len(block.node_ids)))[:, 0]
        dz = (dh2 @ params["w1"].T) * activation(self.act)[1](seen["z"])
        cut = np.flatnonzero(block.node_cut)
        grads = {"w1": seen["h"].T @ dh2, "b1": d[mine].sum(axis=0), "s1": ds1, "d1": dd1, "b0": dz.sum(axis=0)}
        back = {int(block.node_ids[i]): dz[i] for i in cut}
        dz = dz.reshape(-1, self.heads, self.hidden).copy()
        dz[cut] = 0  # their edges lie elsewhere
        return loss, grads | self._into_first(block, seen["one"], dz, seen["first"]), back

    def _into_first(self, block: Block, one: _Heads, d: np.ndarray, first: tuple) -> Params:
        dh, down, ds, dd = one.backward(d, *first)
        if len(dh):
            dh = dh + _sums(down, self._ends(block)[0], len(dh))
        return {"w0": block.x.T @ dh.reshape(len(dh), self.heads * self.hidden), "s0": ds, "d0": dd}

    def through(self, blocks, params, totals, backward):
        if not backward:
            return 0.0
        none = {k: np.zeros_like(p) for k, p in params.items()}

        def piece(block):
            node = int(block.ids[0])
            top, total, summed = _parted(totals["nodes"][node], self.heads, self.hidden)
            d = backward.get(node)
            if d is None:
                return []
            first = tuple(x[None] for x in (top, total, summed / total[:, None]))
            one = self._first_layer(block, params)
            return [(-1, _flat(none | self._into_first(block, one, d.reshape(1, self.heads, self.hidden), first)))]

        return _pass(blocks.split_nodes, blocks.many, piece).get(-1, 0.0)

    def shares(self, blocks: Blocks, params: Params) -> DataFrame:
        """(src, dst, head, share): the first layer's weights of all edges to nodes that are not split; a node's add up to 1 for each head."""
        heads = self.heads

        def weights(batches):
            for batch in batches:
                for block in _read(batch):
                    one = self._first_layer(block, params)
                    top, total, _ = one.partial()
                    share = np.exp(one.e - top[one.dst]) / total[one.dst]
                    cols = [np.repeat(block.far_ids[one.src], heads), np.repeat(block.node_ids[one.dst], heads), np.tile(np.arange(heads), len(share)), share.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["src", "dst", "head", "share"])

        return blocks.df.mapInArrow(weights, "src long, dst long, head long, share double").distinct()
