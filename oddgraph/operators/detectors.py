"""Scores of the detectors whose formulas can be read, losses as queries, and the Spark ML methods."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddgraph.functions import exprs as X
from oddgraph.operators import neighbours as N
from oddgraph.operators.features import gram_rows, prototypes
from oddgraph.sources.graphs import BLOCK, TILE, knn_edges, matrix, strips


def _one_row(centres: DataFrame) -> DataFrame:
    """Two class centres as columns c0 and c1 of one row."""
    return centres.agg(F.max(F.when(F.col("y") == 0, F.col("c"))).alias("c0"), F.max(F.when(F.col("y") == 1, F.col("c"))).alias("c1"))


def prototype_softmax(query: DataFrame, support: DataFrame, width: int, tau: float = 1.0) -> DataFrame:
    """P(anomaly) = softmax of the cosines to the class means, and the log-odds cos1 - cos0 over tau."""
    x = query.crossJoin(F.broadcast(_one_row(prototypes(support, width))))
    a, b = X.cosine("f", "c0") / tau, X.cosine("f", "c1") / tau
    return x.select("id", (1 / (1 + F.exp(a - b))).alias("score"), (b - a).alias("log_odds"))


def centroid_distance(query: DataFrame, support: DataFrame, width: int) -> DataFrame:
    """softmax of minus the squared distances to the class means, scaled to unit length."""
    x = query.crossJoin(F.broadcast(_one_row(prototypes(support, width))))
    x = x.select("id", X.squared_distance("f", "c0").alias("a"), X.squared_distance("f", "c1").alias("b"))
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return x.select("id", F.when(n > 0, 1 / (1 + F.exp((F.col("b") - F.col("a")) / n))).otherwise(0.5).alias("score"))


def support_attention(query: DataFrame, support: DataFrame, width: int) -> DataFrame:
    """|h - attention over the support| with identity weights; the support is a bounded shot."""
    one = F.broadcast(support.agg(F.collect_list("f").alias("cs")))  # one row of a shot
    x = query.select("id", "f").crossJoin(one).withColumn("e", F.transform("cs", lambda c: X.dot("f", c) / (width**0.5)))
    x = x.withColumn("w", F.transform("e", lambda v: F.exp(v - F.array_max("e"))))
    total = F.aggregate("w", F.lit(0.0), lambda s, v: s + v)
    mean = F.aggregate(F.arrays_zip("w", "cs"), X.zeros(width), lambda s, v: F.zip_with(s, v["cs"], lambda p, q: p + q * v["w"]))
    return x.select("id", F.sqrt(X.squared_distance("f", X.scaled(mean, 1 / total))).alias("score"))


def nearest_code(nodes: DataFrame, codes: DataFrame) -> DataFrame:
    """The code of the largest inner product per node, ties to the smaller code; codes are a fixed small table."""
    x = nodes.select("id", "f").crossJoin(F.broadcast(codes.select("code", "c"))).withColumn("s", X.dot("f", "c"))
    best = F.max_by(F.struct("code", "c"), F.struct(F.round("s", 12), -F.col("code")))
    return x.groupBy("id").agg(best.alias("b"), F.max("s").alias("sim")).select("id", F.col("b.code").alias("code"), F.col("b.c").alias("c"), "sim")


def support_and_codes(query: DataFrame, support: DataFrame, codes: DataFrame, scaled_affinity: DataFrame, width: int, lam: float = 0.5) -> DataFrame:
    """(1 - lam) mean of the distances to the support mean and to the mean of its codes + lam * scaled affinity."""
    mean = support.agg(X.avg_vectors("f", width).alias("m"))
    code_mean = nearest_code(support, codes).agg(X.avg_vectors("c", width).alias("k"))
    x = query.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(code_mean)).join(scaled_affinity.select("id", F.col("score").alias("a")), "id")
    d = (F.sqrt(X.squared_distance("f", "m")) + F.sqrt(X.squared_distance("f", "k"))) / 2
    return x.select("id", ((1 - lam) * d + lam * F.col("a")).alias("score"))


def dominant_error(e: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """|z_i Z^T - a_i| per node from one width x width aggregate and an edge join, without N x N."""
    rows = gram_rows(nodes, width)  # width rows
    g = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda r: r["row"]).alias("gram"))
    got = N.both_ends(e, nodes).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * X.dot("fs", "fd")).alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    x = nodes.join(got, "id", "left").na.fill(0.0, ["s", "q"]).crossJoin(F.broadcast(g))
    quad = X.dot("f", F.transform("gram", lambda row: X.dot("f", row)))
    return x.select("id", F.sqrt(F.greatest(quad - 2 * F.col("s") + F.col("q"), F.lit(0.0))).alias("structure"))


def kde(scores: DataFrame, points: int, lo: float, hi: float, bandwidth: float) -> DataFrame:
    """(g, p): normalised Gaussian density of a bounded score sample on a grid."""
    grid = scores.sparkSession.range(points).select(F.col("id").alias("g"), (lo + (hi - lo) * F.col("id") / (points - 1)).alias("x"))
    k = F.exp(-F.pow((F.col("x") - F.col("score")) / bandwidth, F.lit(2.0)) / 2)
    d = scores.select("score").crossJoin(F.broadcast(grid)).groupBy("g").agg(F.sum(k).alias("p"))  # the grid is fixed
    return d.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy()))


def js_distance(p: DataFrame, q: DataFrame) -> DataFrame:
    """Jensen-Shannon distance of two grids."""
    x = p.join(q.withColumnRenamed("p", "q"), "g").withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / F.col("m"))).otherwise(0.0)
    return x.agg(F.sqrt(F.greatest(F.sum(part("p")) / 2 + F.sum(part("q")) / 2, F.lit(0.0))).alias("js"))


def structure_bce(e: DataFrame, nodes: DataFrame, block: int = 2048) -> DataFrame:
    """Mean over all ordered pairs of BCE(logit z_i . z_j, a_ij) = softplus(l) - a l: the softplus part runs
    over pairs of blocks of about ``block`` nodes, the edge part over the edges."""
    soft = pair_sums(nodes, "f", "f", lambda s: np.logaddexp(0, s), block).agg(F.sum("t").alias("soft"))
    edge = N.both_ends(e, nodes).agg(F.sum(F.col("w") * X.dot("fs", "fd")).alias("edge"))
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    return soft.crossJoin(edge).crossJoin(n).select(((F.col("soft") - F.coalesce("edge", F.lit(0.0))) / (F.col("n") * F.col("n"))).alias("loss"))


def link_loss(triplets: DataFrame, nodes: DataFrame, tau: float = 1.0) -> DataFrame:
    """Mean of -log(exp(sim(a, p) / tau) / sum over negatives of exp(sim(a, n) / tau)); triplets(anchor, positive, negative)."""
    v = lambda k, name: nodes.select(F.col("id").alias(k), F.col("f").alias(name))
    x = triplets.join(v("anchor", "a"), "anchor").join(v("positive", "p"), "positive").join(v("negative", "n"), "negative")
    # A cosine is 1 at most, so 1 / tau shifts every exponent to 0 or less.
    shifted = F.log(F.sum(F.exp((X.cosine("a", "n") - 1) / tau))) + 1 / tau
    per = x.groupBy("anchor", "positive").agg(F.first(X.cosine("a", "p") / tau).alias("s"), shifted.alias("l"))
    return per.agg(F.avg(F.col("l") - F.col("s")).alias("loss"))


def margin_loss(pairs: DataFrame, margin: float = 0.0) -> DataFrame:
    """pairs(y, c): normals 1 - c, anomalies max(0, c - margin), mean."""
    return pairs.agg(F.avg(F.when(F.col("y") == 0, 1 - F.col("c")).otherwise(F.greatest(F.lit(0.0), F.col("c") - margin))).alias("loss"))


def pair_sums(nodes: DataFrame, left: str, right: str, of: Callable[[np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(id, t, back): the sums over all nodes j of of(left . right_j) and of of(left_j . right). Nodes are dealt into
    strips; every unordered pair of strips is one task of bounded size that serves both of its strips."""
    import pyarrow as pa

    count, same = strips(nodes, block), left == right
    dealt = nodes.select("id", F.col(left).alias("l"), *([] if same else [F.col(right).alias("r")]), F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("b"))
    other = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    pairs = other.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") <= F.col("o")).alias("first"), *[c for c in dealt.columns if c != "b"])

    def sums(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Over the columns and over the rows of of(a b')."""
        rows, cols = np.zeros(len(a)), np.zeros(len(b))
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                t = of(a[i : i + TILE] @ b[j : j + TILE].T)
                rows[i : i + TILE] += t.sum(axis=1)
                cols[j : j + TILE] += t.sum(axis=0)
        return rows, cols

    def total(group: pa.Table) -> pa.Table:
        alone, side, ids = group["i"][0] == group["j"][0], group["first"].to_numpy(), group["id"].to_numpy()
        l = matrix(group["l"])  # noqa: E741
        r = l if same else matrix(group["r"])
        t, back = sums(l[side], r[side]) if alone else sums(l[side], r[~side])
        if alone:
            return pa.table({"id": ids[side], "t": t, "back": back})
        u, forth = (back, t) if same else sums(l[~side], r[side])
        return pa.table({"id": np.concatenate([ids[side], ids[~side]]), "t": np.concatenate([t, u]), "back": np.concatenate([forth, back])})

    found = pairs.repartition(count * (count + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(total, "id long, t double, back double")
    return found.groupBy("id").agg(F.sum("t").alias("t"), F.sum("back").alias("back"))


def exp_sums(nodes: DataFrame, left: str, right: str, tau: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(id, t, back): the sums over all nodes j of exp(left . right_j / tau) and of exp(left_j . right / tau)."""
    return pair_sums(nodes, left, right, lambda s: np.exp(s / tau), block)


def contrast_loss(e: DataFrame, nodes: DataFrame, batch: int = 1000, tau: float = 1.0) -> DataFrame:
    """Mean of means over logical blocks of -log(positives / all) of exp(cos / tau): the positives are the
    pairs of e, the denominator runs over all nodes; blocks of consecutive ids only average."""
    k = F.exp(X.dot("fs", "fd") / tau)
    positive = N.both_ends(e.select("src", "dst").distinct(), nodes, "u").groupBy(F.col("src").alias("id")).agg(F.sum(k).alias("p"))
    per = exp_sums(nodes, "u", "u", tau).join(positive, "id", "left").na.fill(0.0, ["p"])
    one = -F.log(F.greatest("p", F.lit(1e-8)) / F.greatest("t", F.lit(1e-8)))
    return per.groupBy(F.floor(F.col("id") / batch).alias("b")).agg(F.avg(one).alias("l")).agg(F.avg("l").alias("loss"))


def prune_by(e: DataFrame, nodes: DataFrame, values: DataFrame, width: int, ratio: float) -> DataFrame:
    """On the graph with unit loops l = y - A_norm y of values(id, f); the int(ratio E) edges of the smallest
    l_s . l_d go, by (value, src, dst); loops compete too and are restored."""
    from oddgraph.operators import edges as G
    from oddgraph.operators.metrics import smallest
    from oddgraph.operators.propagate import cut, spmm

    full = cut(G.unit_loops(e, nodes))
    got = spmm(G.norm_sym_transposed(full), values.select("id", "f"), width).withColumnRenamed("f", "g")
    l = values.select("id", "f").join(got, "id").select("id", X.minus("f", "g").alias("f"))  # noqa: E741
    scored = cut(N.both_ends(full, l).select("src", "dst", F.round(X.dot("fs", "fd"), 12).alias("v")))
    gone = smallest(scored, int(ratio * full.count()), ["v", "src", "dst"]).where("src <> dst").select("src", "dst")
    return full.join(gone, ["src", "dst"], "left_anti")


def prune_edges(e: DataFrame, nodes: DataFrame, ratio: float) -> DataFrame:
    """prune_by with the labels y as the one value."""
    return prune_by(e, nodes, nodes.select("id", F.array(F.col("y").cast("double")).alias("f")), 1, ratio)


def _assembled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("features", array_to_vector("f"))


def classified(train: DataFrame, query: DataFrame, model: str = "rf", seed: int = 0) -> DataFrame:
    """P(anomaly) by a weighted forest, boosted trees or logistic regression over features f."""
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    weight = F.when(F.col("y") == 1, n.get(0, 1) / max(1, n.get(1, 1))).otherwise(1.0)
    kinds = {
        "rf": lambda: RandomForestClassifier(labelCol="y", weightCol="cw", numTrees=200, seed=seed),
        "gbt": lambda: GBTClassifier(labelCol="y", weightCol="cw", maxIter=50, seed=seed),
        "lr": lambda: LogisticRegression(labelCol="y", weightCol="cw", regParam=0.01),
    }
    fitted = kinds[model]().fit(_assembled(train.withColumn("cw", weight)))
    return fitted.transform(_assembled(query)).select("id", vector_to_array("probability")[1].alias("score"))


def lsh_neighbours(nodes: DataFrame, k: int, radius: float = 1.3, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Approximate: random-projection candidates by buckets, exact cosine rerank, top k.

    Unit vectors of many dimensions lie in two buckets a table, so that a wide radius makes candidates of nearly all
    pairs: they are weighed by pairs of strips, not joined row by row. The model's projections depend on width and seed alone.
    """
    x = nodes.where("u is not null").select("id", array_to_vector("u").alias("features"), "u")
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=1.0, numHashTables=4, seed=seed).fit(x)
    bucket = F.array(*[vector_to_array(F.col("h")[t])[0] for t in range(lsh.getNumHashTables())])
    return knn_edges(lsh.transform(x).select("id", "u", bucket.alias("h")), k, block, radius)


def kmeans_codes(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(code, c): k-means centres over f."""
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(_assembled(nodes))
    return nodes.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "code int, c array<double>")


def hop_attention(hops: DataFrame, count: int, width: int, slope: float = 0.2) -> DataFrame:
    """Attention over hop residuals with identity weights: softmax over l of leaky(x0 . (x_l - x0) / sqrt(h))
    times the residuals; h0..hL in, f out."""
    logits = [X.dot("h0", X.minus(f"h{k}", "h0")) / (width**0.5) for k in range(1, count + 1)]
    x = hops.withColumns({f"_l{k}": F.when(a > 0, a).otherwise(slope * a) for k, a in enumerate(logits, 1)})
    top = F.array_max(F.array(*[F.col(f"_l{k}") for k in range(1, count + 1)]))
    x = x.withColumns({f"_e{k}": F.exp(F.col(f"_l{k}") - top) for k in range(1, count + 1)})
    total = sum((F.col(f"_e{k}") for k in range(2, count + 1)), F.col("_e1"))
    out = None
    for k in range(1, count + 1):
        part = X.scaled(X.minus(f"h{k}", "h0"), F.col(f"_e{k}") / total)
        out = part if out is None else F.zip_with(out, part, lambda a, b: a + b)
    return x.select("id", out.alias("f"))


def query_with_affinity(query: DataFrame, scores: DataFrame, lam: float = 0.1) -> DataFrame:
    """(1 - lam) q + lam (1 - minmax(l2 + l1 + cos)); query(id, q), scores(id, l2, l1, cos)."""
    total = N.inverted(scores.select("id", (F.col("l2") + F.col("l1") + F.col("cos")).alias("m")))
    return query.join(total.withColumnRenamed("score", "a"), "id").select("id", ((1 - lam) * F.col("q") + lam * F.col("a")).alias("score"))


def context_contrast(e: DataFrame, nodes: DataFrame, width: int, rounds: int = 256, size: int = 4, batch: int = 64) -> DataFrame:
    """Mean over rounds of -(sigma(pos) - sigma(neg)): a node against the mean of its sampled context and
    against the context of its negative in the logical batch.

    The product with a context's mean is the mean of the products with its draws, so each node is multiplied once
    with the out-neighbours of the two nodes whose contexts it reads, and the rounds draw from these numbers, which
    lie in one row; no context is written. Of a node with more neighbours than draws only the drawn ones are kept.
    """
    from oddgraph.operators.sampling import drawn_rank, negative_in_batch

    slots = size - 1
    most = rounds * slots
    w = Window.partitionBy("src")
    near = e.select("src", "dst", F.row_number().over(w.orderBy("dst")).alias("r"), F.count("*").over(w).alias("k"))
    one = lambda name, i: drawn_rank("k", F.floor(i / slots).cast("int"), name, i % slots + 1)
    hubs = near.where((F.col("r") == 1) & (F.col("k") > most)).select("src", "k", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("i"))
    drawn = hubs.select("src", one("src", F.col("i")).alias("r")).distinct()
    alone = nodes.select(F.col("id").alias("src")).join(e.select("src"), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1).alias("r"), F.lit(1).cast("long").alias("k"))
    near = near.where(F.col("k") <= most).union(near.where(F.col("k") > most).join(drawn, ["src", "r"], "left_semi").select(*near.columns)).union(alone)
    reads = nodes.select("id", "f").join(negative_in_batch(nodes, batch), "id")
    reads = reads.select("id", "f", F.explode(F.array(F.struct(F.col("id").alias("src"), F.lit(-1.0).alias("sign")), F.struct(F.col("negative").alias("src"), F.lit(1.0).alias("sign")))).alias("c"))
    x = near.join(nodes.select(F.col("id").alias("dst"), F.col("f").alias("fd")), "dst").join(reads.select("id", "f", "c.src", "c.sign"), "src")
    x = x.select("id", "src", "sign", "k", F.struct("r", X.dot("f", "fd").alias("p")).alias("p"))
    x = x.groupBy("id", "src", "sign", "k").agg(F.sort_array(F.collect_list("p")).alias("p"))
    x = x.select("id", "src", "sign", "k", F.transform("p", lambda p: p["p"]).alias("p"), F.when(F.col("k") > most, F.map_from_entries("p")).alias("at"))

    def draw(i):
        r = one("src", i)
        return F.when(F.col("k") > most, F.element_at("at", r)).otherwise(F.element_at("p", r))

    def sigma(t):
        total = draw(t * slots)
        for s in range(1, slots):
            total = total + draw(t * slots + s)
        return 1 / (1 + F.exp(-total / slots))

    mean = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.lit(0.0), lambda a, t: a + sigma(t)) / rounds
    return x.select("id", (F.col("sign") * mean).alias("s")).groupBy("id").agg(F.sum("s").alias("score"))


def tam(e: DataFrame, nodes: DataFrame, width: int, cuttings: int = 1, trees: int = 1, seed: int = 0) -> DataFrame:
    """(id, score): 1 - minmax of the mean affinity. Each cutting drops the longer edges of the graph the one
    before has left, once for each tree by a draw of its own; the features, propagated once over what is left
    with loops added, give the affinity on the whole graph with loops. e holds both directions, without loops."""
    from oddgraph.operators import edges as G
    from oddgraph.operators.propagate import cut, spmm
    from oddgraph.operators.sampling import truncated

    loops = cut(G.add_loops_raw(e, nodes))
    left, found = {t: e.select("src", "dst") for t in range(trees)}, None
    for c in range(cuttings):
        for t in range(trees):
            left[t] = cut(truncated(N.edge_distance(left[t].withColumn("w", F.lit(1.0)), nodes), seed + c * trees + t))
            a = G.norm_sym_column(G.add_loops_raw(left[t].withColumn("w", F.lit(1.0)), nodes))
            x = spmm(a, nodes.select("id", "f"), width)
            m = N.affinity(loops, x.withColumn("u", X.unit("f")))
            found = m if found is None else found.union(m)
    return N.inverted(cut(found.groupBy("id").agg(F.avg("m").alias("m"))))


def dominant(e: DataFrame, nodes: DataFrame, width: int, alpha: float = 0.8) -> DataFrame:
    """(id, score): alpha times the attribute error plus the rest times the structure error. The embeddings are
    the features propagated once over A + I, normalised; their attributes are decoded by propagating once more."""
    from oddgraph.operators import edges as G
    from oddgraph.operators.propagate import cut, spmm

    loops = cut(G.add_loops_raw(e, nodes))
    a = cut(G.norm_sym_transposed(loops))
    z = cut(spmm(a, nodes.select("id", "f"), width))
    back = spmm(a, z, width).withColumnRenamed("f", "g")
    attribute = nodes.select("id", "f").join(back, "id").select("id", F.sqrt(X.squared_distance("f", "g")).alias("attribute"))
    both = attribute.join(dominant_error(loops, z, width), "id")
    return both.select("id", (alpha * F.col("attribute") + (1 - alpha) * F.col("structure")).alias("score"))


def alignment_loss(e: DataFrame, nodes: DataFrame, tau: float = 1.0) -> DataFrame:
    """Both directions of identity contrast and neighbour-weighted contrast between views f and g against
    all keys; nodes(id, f, g)."""
    from oddgraph.operators.propagate import cut

    x = nodes.select("id", X.unit("f").alias("f"), X.unit("g").alias("g"))
    s = X.dot("f", "g") / tau
    near = e.select("src", "dst", "w").join(x.select(F.col("id").alias("src"), "f"), "src").join(x.select(F.col("id").alias("dst"), "g"), "dst")
    near = near.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w", s.alias("s"))
    out, sums = None, cut(exp_sums(x, "f", "g", tau))
    for one, way in (("i", "t"), ("j", "back")):
        log_sum = sums.select("id", F.log(way).alias("z"))
        same = x.select("id", s.alias("s")).join(log_sum, "id").agg(F.avg(F.col("z") - F.col("s")).alias("v"))
        per = near.join(log_sum.withColumnRenamed("id", one), one).groupBy(one).agg((F.sum(F.col("w") * (F.col("z") - F.col("s"))) / F.sum("w")).alias("v"))
        both = same.union(per.agg(F.avg("v").alias("v")))
        out = both if out is None else out.union(both)
    return out.agg((F.sum("v") / 2).alias("loss"))


def prompt_entropy(weights: DataFrame) -> DataFrame:
    """Mean entropy of gate weights; weights(id, f) with non-negative entries of sum 1."""
    h = F.aggregate("f", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return weights.agg(F.avg(h).alias("entropy"))
