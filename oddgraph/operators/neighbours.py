"""Statistics over neighbourhoods: affinity, distances, diversity, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddgraph.functions import exprs as X
from oddgraph.operators import edges as G


def both_ends(e: DataFrame, nodes: DataFrame, f: str = "f") -> DataFrame:
    """Edges with the vectors of both ends, fs and fd."""
    s, d = (nodes.select(F.col("id").alias(k), F.col(f).alias(v)) for k, v in (("src", "fs"), ("dst", "fd")))
    return e.join(s, "src").join(d, "dst")


def minmax(df: DataFrame, name: str, eps: float = 0.0) -> DataFrame:
    """(x - min) / (max - min + eps); a constant column becomes 0."""
    bounds = df.agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))  # one row
    spread = F.col("_hi") - F.col("_lo") + eps
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, F.when(spread > 0, (F.col(name) - F.col("_lo")) / spread).otherwise(0.0)).drop("_lo", "_hi")


def _affinity(e: DataFrame, nodes: DataFrame, divisor: DataFrame, eps: float) -> DataFrame:
    got = both_ends(e, nodes, "u").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * X.dot("fs", "fd")).alias("s"))
    d = F.col("d") + eps
    return nodes.select("id").join(got, "id", "left").join(divisor.select("id", "d"), "id", "left").select(
        "id", F.when(d > 0, F.coalesce("s", F.lit(0.0)) / d).otherwise(0.0).alias("m")
    ).na.fill(0.0)


def affinity(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted cosine to the out-neighbours over the column sum; nodes carry unit vectors u."""
    return _affinity(e, nodes, G.in_degree(e), 0.0)


def affinity_row(e: DataFrame, nodes: DataFrame, eps: float = 1e-9) -> DataFrame:
    return _affinity(e, nodes, G.out_degree(e), eps)


def inverted(m: DataFrame, name: str = "m") -> DataFrame:
    """score = 1 - minmax."""
    return minmax(m, name).select("id", (1 - F.col(name)).alias("score"))


def nonedge_regulariser(e: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Per node (u.S - sum over out-edges of w u.u') / (N - r), S the sum of all unit vectors."""
    whole = nodes.agg(X.sum_vectors("u", width).alias("whole"), F.count("*").alias("N"))  # one row
    got = both_ends(e, nodes, "u").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * X.dot("fs", "fd")).alias("s"), F.sum("w").alias("r"))
    x = nodes.select("id", "u").join(got, "id", "left").na.fill(0.0, ["s", "r"]).crossJoin(F.broadcast(whole))
    return x.select("id", ((X.dot("u", "whole") - F.col("s")) / (F.col("N") - F.col("r"))).alias("m"))


def neighbour_scores(e: DataFrame, nodes: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Mean L2, mean L1 and mean cosine to the out-neighbours, each min-max scaled; isolated nodes 0 before scaling."""
    x = both_ends(e, nodes)
    got = x.groupBy(F.col("src").alias("id")).agg(
        F.avg(F.sqrt(X.squared_distance("fs", "fd"))).alias("l2"), F.avg(X.l1("fs", "fd")).alias("l1"), F.avg(X.cosine("fs", "fd")).alias("cos")
    )
    out = nodes.select("id").join(got, "id", "left").na.fill(0.0)
    for c in ("l2", "l1", "cos"):
        out = minmax(out, c, eps)
    return out


def smoothness(e: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(j, smooth): mean squared difference over the edges per column of the min-max scaled features."""
    scaled = minmax_columns(nodes, width)
    x = both_ends(e, scaled)
    one = x.agg(*[F.avg((F.col("fs")[i] - F.col("fd")[i]) * (F.col("fs")[i] - F.col("fd")[i])).alias(f"c{i}") for i in range(width)])
    return one.select(F.posexplode(F.array(*[f"c{i}" for i in range(width)])).alias("j", "smooth"))


def smoothness_composite(e: DataFrame, nodes: DataFrame, width: int, alpha: float = 0.5) -> DataFrame:
    """(j, score): alpha times the edge term plus the rest times the population variance, on scaled columns."""
    scaled = minmax_columns(nodes, width)
    v = scaled.agg(*[F.var_pop(F.col("f")[i]).alias(f"v{i}") for i in range(width)]).select(F.posexplode(F.array(*[f"v{i}" for i in range(width)])).alias("j", "var"))
    return smoothness(e, nodes, width).join(v, "j").select("j", (alpha * F.col("smooth") + (1 - alpha) * F.col("var")).alias("score"))


def minmax_columns(nodes: DataFrame, width: int) -> DataFrame:
    f = F.col("f")
    b = nodes.agg(F.array(*[F.min(f[i]) for i in range(width)]).alias("_lo"), F.array(*[F.max(f[i]) for i in range(width)]).alias("_hi"))  # one row

    def one(i: int) -> Column:
        spread = F.col("_hi")[i] - F.col("_lo")[i]
        return F.when(spread > 0, (f[i] - F.col("_lo")[i]) / spread).otherwise(0.0)

    return nodes.crossJoin(F.broadcast(b)).withColumn("f", F.array(*[one(i) for i in range(width)])).drop("_lo", "_hi")


def edge_distance(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return both_ends(e, nodes).select("src", "dst", F.sqrt(X.squared_distance("fs", "fd")).alias("dist"))


def mean_active_distance(d: DataFrame) -> DataFrame:
    return d.where("dist <> 0").agg(F.avg("dist").alias("mean_dist"))


def lookup_edges(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """The weight of given (src, dst) pairs, 0 where there is no edge."""
    return pairs.join(e.select("src", "dst", "w"), ["src", "dst"], "left").na.fill(0.0, ["w"])


def clustering(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree over the largest degree, and the clustering coefficient, on an undirected loop-free table.

    Each triangle is found once: edges point from the smaller (degree, id) to the larger, which bounds
    the wedges of hubs.
    """
    k = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    x = e.select("src", "dst").join(k.select(F.col("id").alias("src"), F.col("k").alias("ks")), "src").join(k.select(F.col("id").alias("dst"), F.col("k").alias("kd")), "dst")
    up = x.where((F.col("ks") < F.col("kd")) | ((F.col("ks") == F.col("kd")) & (F.col("src") < F.col("dst")))).select("src", "dst")
    wedge = up.select("src", F.col("dst").alias("b")).join(up.select("src", F.col("dst").alias("c")), "src").where("b <> c")
    tri = wedge.join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    per = tri.select(F.explode(F.array("src", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    top = k.agg(F.max("k").alias("top"))  # one row
    out = nodes.select("id").join(k, "id", "left").join(per, "id", "left").na.fill(0, ["k", "t"]).crossJoin(F.broadcast(top))
    return out.select("id", (F.col("k") / F.col("top")).alias("degree"), F.when(F.col("k") > 1, 2.0 * F.col("t") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def structural_fingerprint(local: DataFrame, e: DataFrame, names: list[str]) -> DataFrame:
    """Local values and the mean of the neighbours' values, the centre left out; isolated nodes 0."""
    got = e.join(local.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.avg(c).alias(f"pooled_{c}") for c in names])
    return local.join(got, "id", "left").na.fill(0.0)


def diversity(e: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Population variance of the pairwise cosines among a node's neighbours, by the sums S of the unit
    vectors and of the squared cosines. Up to ``width`` neighbours the squares come from the list of their
    vectors, beyond that from the rows of the outer-product sum, so no list grows with a hub."""
    k = e.groupBy("src").agg(F.count("*").alias("k"))
    x = e.select("src", "dst").join(k, "src").join(nodes.select(F.col("id").alias("dst"), "u"), "dst")
    few = x.where(F.col("k") <= width).groupBy("src").agg(F.count("*").alias("n"), F.collect_list("u").alias("us"))
    one = lambda a: F.aggregate("us", F.lit(0.0), lambda s, b: s + a(b))
    first = F.aggregate("us", F.lit(0.0), lambda s, a: s + one(lambda b: X.dot(a, b)))
    square = F.aggregate("us", F.lit(0.0), lambda s, a: s + one(lambda b: X.dot(a, b) * X.dot(a, b)))
    few = few.select("src", "n", first.alias("a"), square.alias("b"))
    row = x.where(F.col("k") > width).select("src", F.posexplode("u").alias("i", "ui"), "u")
    row = row.groupBy("src", "i").agg(F.count("*").alias("n"), F.sum("ui").alias("s"), X.sum_vectors("u", width, F.col("ui")).alias("o"))
    many = row.groupBy("src").agg(F.first("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("a"), F.sum(X.dot("o", "o")).alias("b"))
    n, p = F.col("n"), F.col("n") * (F.col("n") - 1.0)
    mean, second = (F.col("a") - n) / p, (F.col("b") - n) / p
    got = few.union(many).select(F.col("src").alias("id"), F.when(n >= 2, F.greatest(second - mean * mean, F.lit(0.0))).otherwise(0.0).alias("m"))
    return nodes.select("id").join(got, "id", "left").na.fill(0.0)


def compatibility(e: DataFrame, nodes: DataFrame, tau: float = 1.0) -> DataFrame:
    """Edges weighted by exp(-|a_s - a_d|^2 / tau)."""
    return both_ends(e, nodes).select("src", "dst", F.exp(-X.squared_distance("fs", "fd") / tau).alias("w"), "fd")


def compatible_mean(e: DataFrame, nodes: DataFrame, width: int, tau: float = 1.0) -> DataFrame:
    """Per node the compatibility-weighted mean of the neighbours (rep), 1 - mean compatibility
    (topology) and the distance of the node to that mean (drift); isolated nodes 0."""
    c = compatibility(e, nodes, tau)
    got = c.groupBy(F.col("src").alias("id")).agg(X.sum_vectors("fd", width, F.col("w")).alias("s"), F.sum("w").alias("t"), F.avg("w").alias("c"))
    x = nodes.select("id", "f").join(got, "id", "left").withColumn("rep", F.coalesce(X.scaled("s", 1 / F.col("t")), F.col("f")))
    return x.select("id", "rep", F.coalesce(1 - F.col("c"), F.lit(0.0)).alias("topology"), F.sqrt(X.squared_distance("f", "rep")).alias("drift"))


def global_similarity(e: DataFrame, nodes: DataFrame, low: float = 0.0) -> DataFrame:
    """Mean cosine over the edges."""
    return both_ends(e, nodes).agg(F.avg(X.cosine("fs", "fd")).alias("similarity"), F.count("*").alias("n_edges"))


def ego_neighbour_difference(e: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """-cos(own vector, mean of the out-neighbours) and 1 - minmax(cos)."""
    got = e.join(nodes.select(F.col("id").alias("dst"), "f"), "dst").groupBy(F.col("src").alias("id")).agg(X.avg_vectors("f", width).alias("m"))
    c = nodes.select("id", "f").join(got, "id", "left").select("id", F.when(F.col("m").isNull(), 0.0).otherwise(X.cosine("f", "m")).alias("c"))
    return c.join(inverted(c, "c").withColumnRenamed("score", "scaled"), "id").select("id", (-F.col("c")).alias("diff"), "scaled")
