"""Sparse products and what is iterated from them. Features are ARRAY<DOUBLE>; one sum per dimension."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import comb, factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddgraph.functions.exprs import minus, scaled, sum_vectors, zeros
from oddgraph.operators import edges as G


def spmm(e: DataFrame, x: DataFrame, width: int, f: str = "f") -> DataFrame:
    """A X: each source sums the rows of its destinations; isolated nodes get zeros."""
    got = e.join(x.select(F.col("id").alias("dst"), F.col(f).alias("_f")), "dst").groupBy(F.col("src").alias("id")).agg(sum_vectors("_f", width, F.col("w")).alias("_s"))
    return x.join(got, "id", "left").select(*[c for c in x.columns if c != f], F.coalesce("_s", zeros(width)).alias(f))


def spmm_t(e: DataFrame, x: DataFrame, width: int, f: str = "f") -> DataFrame:
    """A transposed X: each destination sums the rows of its sources."""
    return spmm(G.flipped(e), x, width, f)


def propagate(e: DataFrame, x: DataFrame, hops: int, width: int, add_loop: bool = True) -> DataFrame:
    """x'(d) = sum over in-edges of w δ(s) δ(d) x(s) + x(d) / deg(d), δ = deg^-1/2, where the degree
    counts the added loop; without it the last term falls away. Keeps all hops as h0..hL."""
    degree = G.out_degree(e.select(G.E).union(G.loops(x)) if add_loop else e).select("id", "d")
    d = F.when(F.col("d") > 0, F.col("d"))
    s, t = degree.select(F.col("id").alias("src"), F.pow(d, -0.5).alias("ds")), degree.select(F.col("id").alias("dst"), F.pow(d, -0.5).alias("dd"))
    a = e.join(s, "src").join(t, "dst").select("src", "dst", (F.col("w") * F.col("ds") * F.col("dd")).alias("w"))
    if add_loop:
        a = a.union(degree.select(F.col("id").alias("src"), F.col("id").alias("dst"), (1 / d).alias("w")))
    out = x.select("id", F.col("f").alias("h0"))
    for hop in range(1, hops + 1):
        step = spmm_t(a, out.select("id", F.col(f"h{hop - 1}").alias("f")), width)
        out = out.join(step.withColumnRenamed("f", f"h{hop}"), "id")
    return out


def laplacian_powers(e: DataFrame, x: DataFrame, order: int, width: int) -> DataFrame:
    """h0..hd with h(k+1) = L h(k), L = I - D^-1/2 A D^-1/2 over in-counts of at least 1, weights ignored."""
    k = G.in_degree(e).select("id", "k")
    nodes = x.select("id").join(k, "id", "left").select("id", F.pow(F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)).cast("double"), -0.5).alias("p"))
    a = e.join(nodes.select(F.col("id").alias("src"), F.col("p").alias("ps")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("p").alias("pd")), "dst")
    a = a.select("src", "dst", (F.col("ps") * F.col("pd")).alias("w"))
    out = x.select("id", F.col("f").alias("h0"))
    for hop in range(1, order + 1):
        step = spmm_t(a, out.select("id", F.col(f"h{hop - 1}").alias("f")), width).withColumnRenamed("f", "_m")
        out = out.join(step, "id").withColumn(f"h{hop}", minus(f"h{hop - 1}", "_m")).drop("_m")
        if hop % 2 == 0 and hop < order:
            out = cut(out)  # a hop reads the one before it twice
    return out


def beta_theta(order: int) -> list[list[float]]:
    """Coefficients of L^k in the Beta filters i = 0..order."""
    return [
        [factorial(order + 1) / (factorial(i) * factorial(order - i)) * comb(order - i, k - i) * (-1) ** (k - i) / 2**k if k >= i else 0.0 for k in range(order + 1)]
        for i in range(order + 1)
    ]


def wavelets(powers: DataFrame, order: int) -> DataFrame:
    """One column per filter, b0..bd, all over the shared powers."""
    cols = []
    for i, theta in enumerate(beta_theta(order)):
        total = scaled("h0", theta[0])
        for k in range(1, order + 1):
            total = F.zip_with(total, scaled(f"h{k}", theta[k]), lambda a, b: a + b)
        cols.append(total.alias(f"b{i}"))
    return powers.select("id", *cols)


def neighbour_aggregate(e: DataFrame, x: DataFrame, width: int, how: str) -> DataFrame:
    """Incoming sum, mean or max of features; nodes without in-edges get zeros."""
    f = F.col("_f")
    one = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    got = e.join(x.select(F.col("id").alias("src"), F.col("f").alias("_f")), "src").groupBy(F.col("dst").alias("id")).agg(F.array(*[one(f[i]) for i in range(width)]).alias("_s"))
    return x.select("id").join(got, "id", "left").select("id", F.coalesce("_s", zeros(width)).alias("f"))


def gin_features(e: DataFrame, x: DataFrame, layers: int, width: int, how: str = "mean") -> DataFrame:
    """X, AX, ..., A^L X side by side, without parameters."""
    out, last = x.select("id", "f"), x.select("id", "f")
    for hop in range(layers):
        last = neighbour_aggregate(e, last, width, how)
        if hop % 2 == 1 and hop + 1 < layers:
            last = cut(last)
        out = out.join(last.withColumnRenamed("f", "_n"), "id").select("id", F.concat("f", "_n").alias("f"))
    return out


def ego_residual(hops: DataFrame, count: int) -> DataFrame:
    """h1 - h0, ..., hL - h0 side by side."""
    return hops.select("id", F.concat(*[minus(f"h{k}", "h0") for k in range(1, count + 1)]).alias("f"))


def pagerank(e: DataFrame, nodes: DataFrame, rounds: int = 10, alpha: float = 0.85) -> DataFrame:
    """Fixed rounds; the mass of nodes without out-edges is spread evenly."""
    n = max(nodes.count(), 1)
    a = cut(G.norm_row(e))
    rank = nodes.select("id", F.lit(1.0 / n).alias("p"))
    for _ in range(rounds):
        got = a.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("p")).alias("g"))
        step = cut(rank.join(got, "id", "left").select("id", F.coalesce("g", F.lit(0.0)).alias("g")))  # read twice
        lost = step.agg((1 - F.sum("g")).alias("lost"))
        rank = step.crossJoin(F.broadcast(lost)).select("id", ((1 - alpha) / n + alpha * (F.col("g") + F.col("lost") / n)).alias("p"))  # one row
    return rank


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Jobs of frames made in here delete the files that they shuffled when they end."""
    was = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, was)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share. The shuffled files that were needed for it go at once, not
    when the driver's memory happens to be cleaned."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/.checkpoints")
    with released(spark):
        return df.select("*").checkpoint()


def dropped(*frames: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned and that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if found.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(found.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def k_core(e: DataFrame, k: int) -> DataFrame:
    """Ids of the k-core of an undirected loop-free edge table: peel until nothing falls away."""
    kept = cut(e.select("src", "dst"))
    while True:
        strong = kept.groupBy(F.col("src").alias("id")).count().where(F.col("count") >= k).select("id")
        new = cut(kept.join(strong.withColumnRenamed("id", "src"), "src", "left_semi").join(strong.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        if new.count() == kept.count():
            return new.select(F.col("src").alias("id")).distinct()
        kept = new


def closure(e: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Ids within so many out-hops of the seeds, the seeds included."""
    seen = seeds.select("id").distinct()
    for _ in range(hops):
        near = e.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        seen = seen.union(near).distinct()
    return seen


def induced(e: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids; weights stay as they are."""
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
