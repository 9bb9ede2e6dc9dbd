"""Iterated structure of a graph: core numbers, PageRank to a tolerance, spectral positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.operators import edges as G
from oddgraph.operators import exchange as B
from oddgraph.operators.propagate import cut, dropped, released


#: Entries of a block about, where nodes have many; rounds of core numbers between two cuts on small graphs, and within a block.
ENTRIES, ROUNDS, WITHIN = 1 << 21, 4, 4


def _h_indices(fixed: B.Fixed, row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each own node, the largest h of which h neighbours have at least h."""
    size = np.int64(1) << 32
    key = np.sort(row * size + (size - 1 - values[fixed.col]))  # by row, larger values first
    rank = np.arange(len(key)) - fixed.at[row] + 1
    return np.bincount(row[size - 1 - key % size >= rank], minlength=len(fixed.ids))


def core_numbers(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, core) of every node on an undirected loop-free edge table; isolated nodes have core 0.

    Starting from the degrees, a node's value becomes the h-index of its neighbours' values, the largest
    h of which h neighbours have at least h; the fixpoint is the core number. Nodes lie in blocks with their
    edges, and a round is one exchange of values; a block whose values fall looks again a few times before it
    sends them, for the order of these steps doesn't change where they end.
    """
    ends = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("v"))
    with released(e.sparkSession):
        n, m = ends.agg(F.count("*"), F.sum("v")).first()
    if not n:
        return nodes.select("id", F.lit(0).cast("long").alias("core"))
    count = max(B.blocks(n), -(-m // ENTRIES))

    def first(q, fixed, ids, v):
        return (np.diff(fixed.at).astype(np.int32), True), []

    def send(q, fixed, state, inbox):
        return state, fixed.sent(state[0])

    def fall(q, fixed, state, inbox):
        core, row, fell = state[0].copy(), np.repeat(np.arange(len(fixed.ids)), np.diff(fixed.at)), False
        seen = fixed.seen(core, inbox)
        for _ in range(WITHIN):
            h = np.minimum(_h_indices(fixed, row, seen), core).astype(np.int32)
            if (h == core).all():
                break
            core = seen[: len(core)] = h
            fell = True
        return (core, fell), fixed.sent(core)

    state = cut(B.packed(ends.select("id", F.lit(0).alias("v")), e.select("src", "dst"), count, first))
    while True:
        step = B.local(state, send)
        for _ in range(ROUNDS if count <= B.ABOUT else 1):
            step = B.exchanged(step, count, fall)
        before, state = state, cut(step.where("fixed is not null"))
        dropped(before)
        fell = B.over(state, lambda _, held: pa.RecordBatch.from_arrays([pa.array([held[1]])], ["fell"]), "fell boolean")
        if fell.where("fell").isEmpty():
            core = B.over(state, lambda fixed, held: pa.RecordBatch.from_arrays([pa.array(fixed.ids), pa.array(held[0].astype(np.int64))], ["id", "core"]), "id long, core long")
            return nodes.select("id").join(core, "id", "left").na.fill(0, ["core"])


def core_share(core: DataFrame) -> DataFrame:
    """(id, core): core numbers over the largest one; all 0 where that is 0."""
    top = core.agg(F.max("core").alias("top"))  # one row
    return core.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("core") / F.col("top")).otherwise(0.0).alias("core"))


def pagerank_to(e: DataFrame, nodes: DataFrame, tolerance: float = 1e-6, most: int = 100, alpha: float = 0.85, log: bool = False) -> DataFrame:
    """(id, p, rounds): PageRank until the summed change is below ``tolerance`` times the nodes, at most
    ``most`` rounds; with ``log`` the logarithm. The mass of nodes without out-edges is spread evenly."""
    n = nodes.count()
    a, rank, rounds = cut(G.norm_row(e)), nodes.select("id", F.lit(1.0 / max(n, 1)).alias("p")), 0
    if not n:
        return rank.withColumn("rounds", F.lit(0))
    step = None
    for rounds in range(1, most + 1):  # noqa: B007
        got = a.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("p")).alias("g"))
        before, step = step, cut(rank.join(got, "id", "left").select("id", F.col("p").alias("was"), F.coalesce("g", F.lit(0.0)).alias("g")))
        if before is not None:
            dropped(before)
        kept = step.agg(F.sum("g")).first()[0] or 0.0
        rank = step.select("id", "was", (F.lit((1 - alpha) / n) + alpha * (F.col("g") + (1.0 - kept) / n)).alias("p"))
        if rank.agg(F.sum(F.abs(F.col("p") - F.col("was")))).first()[0] < n * tolerance:
            break
        rank = rank.select("id", "p")
    return rank.select("id", (F.log("p") if log else F.col("p")).alias("p"), F.lit(rounds).alias("rounds"))
