"""The supervised baselines: networks trained on a source graph that score the nodes of a target graph.

A graph is (edges(src, dst, w), nodes(id, f, y)); a null y is a node without a label. Features come in
``rank`` dimensions of the graph's own decomposition, scaled as each method asks for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.operators import edges as G
from oddgraph.operators import features as FT
from oddgraph.operators import networks as W
from oddgraph.operators import propagate as P
from oddgraph.operators import spectral as E
from oddgraph.operators import structure as T

Graph = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Settings:
    """Sizes and schedule of a baseline."""

    scale: str
    epochs: int
    rate: float
    decay: float
    hidden: int
    order: int = 0
    dropout: float = 0.0
    rank: int = 8

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


# The usual settings of the baselines.
MLP = Settings("zscore", 200, 5e-5, 1e-5, 32)
GCN = Settings("none", 200, 1e-5, 0.0, 64, dropout=0.5)
GAT = Settings("zscore", 300, 5e-5, 1e-6, 8)
BWGNN = Settings("center", 100, 1e-6, 1e-3, 32, order=5)
GHRN = Settings("zscore", 100, 1e-6, 1e-5, 128, order=2)
GHRN_FIRST_EPOCHS, GHRN_DROP = 50, 0.015


def features(nodes: DataFrame, width: int, s: Settings) -> DataFrame:
    """nodes(id, f, y) with f in ``rank`` dimensions, scaled."""
    x = FT.svd_align(nodes.select("id", "f", "y"), width, s.rank) if width > s.rank else nodes.select("id", "f", "y")
    dims = min(width, s.rank)
    return {"zscore": lambda: FT.zscore(x, dims), "center": lambda: FT.center(x, dims), "none": lambda: x}[s.scale]()


def _settled(x: DataFrame) -> DataFrame:
    """Written once, for both training and scores read it."""
    return P.cut(x)


def mlp(source: Graph, target: Graph, width: int, s: Settings = MLP, seed: int = 0) -> DataFrame:
    """(id, score) of a perceptron over a node's own features; no edge is read."""
    dims, net = min(width, s.rank), W.Perceptron(s.hidden)
    blocks = [W.node_blocks(_settled(features(nodes, width, s)), dims) for _, nodes in (source, target)]
    return net.scores(blocks[1], net.train(blocks[0], dims, s.epochs, s.rate, s.decay, seed).params)


def gcn(source: Graph, target: Graph, width: int, s: Settings = GCN, seed: int = 0) -> DataFrame:
    """(id, score) of two graph convolutions over in-counts, on the graph with unit loops."""
    dims, net, blocks = min(width, s.rank), W.Convolution(s.hidden, dropout=s.dropout, seed=seed), []
    for e, nodes in (source, target):
        x = _settled(features(nodes, width, s))
        a = _settled(G.norm_gcn(G.unit_loops(G.binary(e), nodes)))
        once = _settled(P.spmm(a, x.select("id", "f"), dims))
        blocks.append(W.convolution_blocks(G.flipped(a), once, x.select("id", "y"), dims))
    return net.scores(blocks[1], net.train(blocks[0], dims, s.epochs, s.rate, s.decay, seed).params)


def gat(source: Graph, target: Graph, width: int, s: Settings = GAT, seed: int = 0) -> DataFrame:
    """(id, score) of two attention layers, eight heads and one, on the graph with unit loops."""
    dims, net, blocks = min(width, s.rank), W.Attention(s.hidden, act="relu"), []
    for e, nodes in (source, target):
        x = _settled(features(nodes, width, s))
        blocks.append(W.attention_blocks(_settled(G.unit_loops(G.binary(e), nodes)), x.select("id", "f"), x.select("id", "y"), dims))
    return net.scores(blocks[1], net.train(blocks[0], dims, s.epochs, s.rate, s.decay, seed).params)


def wavelet_features(e: DataFrame, x: DataFrame, width: int, order: int) -> DataFrame:
    """x(id, f, ...) with f as its Beta wavelets side by side, on the graph with unit loops."""
    a = _settled(G.unit_loops(G.binary(e), x))
    powers = P.laplacian_powers(a, x.select("id", "f"), order, width)
    bands = P.wavelets(_settled(powers), order).select("id", F.concat(*[f"b{i}" for i in range(order + 1)]).alias("f"))
    return x.drop("f").join(bands, "id")


def bwgnn(source: Graph, target: Graph, width: int, s: Settings = BWGNN, seed: int = 0) -> DataFrame:
    """(id, score) of a perceptron over the Beta wavelets of the features. The filters are linear in the fixed
    features, so they are applied once; the trained layers come behind them."""
    return _wavelet_scores(source, [target], width, s, seed)[0]


def _wavelet_scores(source: Graph, targets: list[Graph], width: int, s: Settings, seed: int) -> list[DataFrame]:
    """What ``bwgnn`` gives for each target, from one training; the source's blocks serve as a target's where it is one."""
    dims, net = min(width, s.rank), W.Perceptron(s.hidden, act="relu")
    wide = dims * (s.order + 1)
    blocks = lambda e, nodes: W.node_blocks(_settled(wavelet_features(e, features(nodes, width, s), dims, s.order)), wide)
    own = blocks(*source)
    others = [own if target is source else blocks(*target) for target in targets]
    params = net.train(own, wide, s.epochs, s.rate, s.decay, seed).params
    return [net.scores(b, params) for b in others]


def pruned(e: DataFrame, nodes: DataFrame, scores: DataFrame, ratio: float = GHRN_DROP) -> DataFrame:
    """Edges left when those go whose ends' predictions differ most from their neighbourhoods' in opposite ways."""
    from oddgraph.operators.detectors import prune_by

    return prune_by(e, nodes, scores.select("id", F.array(1 - F.col("score"), F.col("score")).alias("f")), 2, ratio)


def ghrn(source: Graph, target: Graph, width: int, s: Settings = GHRN, seed: int = 0, ratio: float = GHRN_DROP) -> DataFrame:
    """(id, score): a first, shorter pass scores both graphs, their heterophilous edges are pruned by it, and
    the pass is done again on what is left."""
    first = s.but(epochs=min(GHRN_FIRST_EPOCHS, s.epochs))
    graphs = [source] if target is source else [source, target]
    scored = _wavelet_scores(source, graphs, width, first, seed)
    left = [(_settled(pruned(G.binary(e), nodes, x, ratio)), nodes) for (e, nodes), x in zip(graphs, scored)]
    return _wavelet_scores(left[0], left[-1:], width, s, seed)[0]


def augmented(e: DataFrame, nodes: DataFrame, width: int, positions: int = 16, order: int = 2) -> DataFrame:
    """(id, f): the attributes, the logarithms of degree and PageRank, the positions on the Laplacian's first
    vectors, and the Beta wavelets of the attributes. e is undirected, without loops."""
    degree = G.out_degree(e).select("id", "d")
    logs = nodes.select("id").join(degree, "id", "left").select("id", F.log1p(F.coalesce("d", F.lit(0.0))).alias("degree"))
    rank = T.pagerank_to(e, nodes, log=True).select("id", F.col("p").alias("rank"))
    place = E.laplacian_positions(e, nodes.select("id"), positions).vectors.withColumnRenamed("f", "place")
    bands = wavelet_features(e, nodes.select("id", "f"), width, order).withColumnRenamed("f", "bands")
    x = nodes.select("id", "f").join(logs, "id").join(rank, "id").join(place, "id").join(bands, "id")
    return x.select("id", F.concat("f", F.array("degree", "rank"), "place", "bands").alias("f"))
