"""Edge tables: cleaning, symmetrising, degrees and the named normalisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

E = ["src", "dst", "w"]


def flipped(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def drop_loops(e: DataFrame) -> DataFrame:
    return e.where("src <> dst")


def drop_zero(e: DataFrame) -> DataFrame:
    return e.where("w <> 0")


def dedup_sum(e: DataFrame) -> DataFrame:
    return e.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def loops(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))


def unit_loops(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Existing loops are replaced by one unit loop per node."""
    return drop_loops(e).select(E).union(loops(nodes))


def add_loops_raw(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """A + I: existing loops gain 1."""
    return dedup_sum(e.select(E).union(loops(nodes)))


def maybe_loops(e: DataFrame, nodes: DataFrame, add: bool) -> DataFrame:
    return add_loops_raw(e, nodes) if add else e


def binary(e: DataFrame, keep_loops: bool = True) -> DataFrame:
    """Direction kept, weights 1, explicit zeros are not edges."""
    e = drop_zero(e) if "w" in e.columns else e
    return (e if keep_loops else drop_loops(e)).select("src", "dst").distinct().withColumn("w", F.lit(1.0))


def undirected(e: DataFrame) -> DataFrame:
    """Binary, both directions, no loops."""
    e = (drop_zero(e) if "w" in e.columns else e).where("src <> dst").select("src", "dst")
    return e.union(flipped(e)).distinct().withColumn("w", F.lit(1.0))


def max_symmetric(e: DataFrame, nodes: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """max(A, A transposed), then max with I; within: ids of an induced subgraph."""
    if within is not None:
        e = e.join(within.select(F.col("id").alias("src")), "src", "left_semi").join(within.select(F.col("id").alias("dst")), "dst", "left_semi")
        nodes = nodes.join(within, "id", "left_semi")
    return e.select(E).union(flipped(e).select(E)).union(loops(nodes)).groupBy("src", "dst").agg(F.max("w").alias("w"))


def validate(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, distinct ids at either end that are no node, non-finite or negative weights, loops."""
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    unknown = ends.join(nodes, "id", "left_anti").agg(F.count("*").alias("unknown_ids"))
    bad = F.isnan("w") | F.abs("w").isin(float("inf")) | (F.col("w") < 0)
    counts = e.agg(F.count("*").alias("n_edges"), F.count_if(bad).alias("bad_weights"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))
    return counts.crossJoin(unknown)  # one row by one row


def out_degree(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"), F.count("*").alias("k"))


def in_degree(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("d"), F.count("*").alias("k"))


def degrees(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted out- and in-degree and in-count of every node; 0 for isolated ones."""
    o, i = out_degree(e).select("id", F.col("d").alias("out_w")), in_degree(e).select("id", F.col("d").alias("in_w"), F.col("k").alias("in_count"))
    return nodes.select("id").join(o, "id", "left").join(i, "id", "left").na.fill(0)


def _power(d: str, p: float):
    return F.when(F.col(d) > 0, F.pow(F.col(d), F.lit(p))).otherwise(0.0)


def _with(e: DataFrame, degree: DataFrame, end: str, name: str, of: str = "d") -> DataFrame:
    return e.join(degree.select(F.col("id").alias(end), F.col(of).cast("double").alias(name)), end, "left").na.fill(0.0, [name])


def norm_sym_transposed(e: DataFrame) -> DataFrame:
    """Edge (d, s) with w r(s)^-1/2 r(d)^-1/2, r the weighted out-degree."""
    r = out_degree(e)
    x = _with(_with(e, r, "src", "rs"), r, "dst", "rd")
    return flipped(x.select("src", "dst", (F.col("w") * _power("rs", -0.5) * _power("rd", -0.5)).alias("w")))


def norm_sym_column(e: DataFrame) -> DataFrame:
    """Edge (s, d) with w c(s)^-1/2 c(d)^-1/2, c the weighted in-degree."""
    c = in_degree(e)
    x = _with(_with(e, c, "src", "cs"), c, "dst", "cd")
    return x.select("src", "dst", (F.col("w") * _power("cs", -0.5) * _power("cd", -0.5)).alias("w"))


def norm_sym_directed(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(A + I) with direction kept and row degrees on both sides."""
    return flipped(norm_sym_transposed(add_loops_raw(e, nodes)))


def norm_gcn(e: DataFrame) -> DataFrame:
    """Edge (d, s) with k(s)^-1/2 k(d)^-1/2, k the in-count."""
    k = in_degree(e)
    x = _with(_with(e, k, "src", "ks", "k"), k, "dst", "kd", "k")
    return flipped(x.select("src", "dst", (_power("ks", -0.5) * _power("kd", -0.5)).alias("w")))


def norm_binary_sym(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return norm_sym_transposed(unit_loops(undirected(e), nodes))


def norm_both(e: DataFrame) -> DataFrame:
    """Edge (d, s) with w / sqrt(r(s) c(d))."""
    x = _with(_with(e, out_degree(e), "src", "rs"), in_degree(e), "dst", "cd")
    return flipped(x.select("src", "dst", (F.col("w") * _power("rs", -0.5) * _power("cd", -0.5)).alias("w")))


def norm_row(e: DataFrame) -> DataFrame:
    return _with(e, out_degree(e), "src", "rs").select("src", "dst", (F.col("w") * _power("rs", -1.0)).alias("w"))


def norm_in(e: DataFrame) -> DataFrame:
    """Random-walk weight 1 / in-count of the destination."""
    return _with(e, in_degree(e), "dst", "kd", "k").select("src", "dst", _power("kd", -1.0).alias("w"))


def norm_column(e: DataFrame) -> DataFrame:
    """Edge values over the column sum of their source."""
    return _with(e, in_degree(e), "src", "cs").select("src", "dst", (F.col("w") * _power("cs", -1.0)).alias("w"))


def norm_difference(e: DataFrame) -> DataFrame:
    """Symmetric normalisation without own messages."""
    return norm_sym_transposed(drop_loops(e))


def norm_residual_pair(e: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The message branch, symmetric with loops added to the raw ones, and the residual branch, row-stochastic without loops."""
    return norm_sym_transposed(add_loops_raw(e, nodes)), norm_row(drop_loops(e))


def block_union(graphs: list[tuple[DataFrame, int]]) -> DataFrame:
    """Disjoint union of edge tables: ids of each graph move by its offset."""
    out = None
    for e, offset in graphs:
        moved = e.select((F.col("src") + offset).alias("src"), (F.col("dst") + offset).alias("dst"), "w")
        out = moved if out is None else out.union(moved)
    return out
