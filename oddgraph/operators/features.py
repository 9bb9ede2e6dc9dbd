"""Column scaling and alignment of node features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddgraph.functions import exprs as X


def _moments(nodes: DataFrame, width: int) -> DataFrame:
    f = F.col("f")
    return nodes.agg(F.array(*[F.avg(f[i]) for i in range(width)]).alias("_m"), F.array(*[F.stddev_pop(f[i]) for i in range(width)]).alias("_s"))  # one row


def zscore(nodes: DataFrame, width: int, eps: float | None = None) -> DataFrame:
    """(x - mean) / population deviation, 0 deviation as 1; with eps as a batch norm, / sqrt(var + eps)."""
    f, m, s = F.col("f"), F.col("_m"), F.col("_s")
    div = lambda i: F.when(s[i] > 0, s[i]).otherwise(1.0) if eps is None else F.sqrt(s[i] * s[i] + eps)
    x = nodes.crossJoin(F.broadcast(_moments(nodes, width)))
    return x.withColumn("f", F.array(*[(f[i] - m[i]) / div(i) for i in range(width)])).drop("_m", "_s")


def center(nodes: DataFrame, width: int) -> DataFrame:
    x = nodes.crossJoin(F.broadcast(_moments(nodes, width)))
    return x.withColumn("f", F.array(*[F.col("f")[i] - F.col("_m")[i] for i in range(width)])).drop("_m", "_s")


def row_normalised(nodes: DataFrame) -> DataFrame:
    """Each row over its sum; a zero sum gives zeros."""
    total = F.aggregate("f", F.lit(0.0), lambda s, x: s + x)
    return nodes.withColumn("f", F.transform("f", lambda x: F.when(total != 0, x / total).otherwise(0.0)))


def gram_rows(nodes: DataFrame, width: int) -> DataFrame:
    """(i, row): the rows of X transposed X. Each task adds up one width x width product over its batches,
    so ``width`` rows a task are shuffled."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def products(batches):
        g = np.zeros((width, width))
        for batch in batches:
            x = pc.list_flatten(batch["f"]).to_numpy(zero_copy_only=False).reshape(-1, width)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(g))], ["i", "row"])

    rows = nodes.where("f is not null").select("f").mapInArrow(products, "i int, row array<double>")
    return rows.groupBy("i").agg(X.sum_vectors("row", width).alias("row"))


def gram(nodes: DataFrame, width: int) -> DataFrame:
    """(i, j, v) of X transposed X, i <= j."""
    return gram_rows(nodes, width).select("i", F.posexplode("row").alias("j", "v")).where("i <= j")


def projected(nodes: DataFrame, m: np.ndarray) -> DataFrame:
    """f times a fixed matrix, which is one row of columns."""
    one = nodes.sparkSession.createDataFrame([([[float(x) for x in c] for c in m.T],)], "_m array<array<double>>")
    return nodes.crossJoin(F.broadcast(one)).withColumn("f", F.transform("_m", lambda c: X.dot("f", c))).drop("_m")


def svd_align(nodes: DataFrame, width: int, rank: int) -> DataFrame:
    """U S of the rank-k truncated decomposition, uncentred: the width x width Gram matrix is the only
    thing on the driver; each right vector's entry of largest size is made positive."""
    g = np.zeros((width, width))
    for r in gram(nodes, width).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    _, v = np.linalg.eigh(g)
    v = v[:, ::-1][:, :rank]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return projected(nodes, v)


def random_projection(nodes: DataFrame, width: int, to: int, seed: int = 0) -> DataFrame:
    """Gaussian projection to more or fewer columns with a fixed matrix."""
    return projected(nodes, np.random.default_rng(seed).standard_normal((width, to)) / np.sqrt(to))


def sign_rule(nodes: DataFrame, width: int) -> DataFrame:
    """Each column times the sign of its entry of largest size, so that entry is positive."""
    f = F.col("f")
    one = nodes.agg(F.array(*[F.max_by(f[i], F.struct(F.abs(f[i]), -F.col("id"))) for i in range(width)]).alias("_t"))  # one row
    x = nodes.crossJoin(F.broadcast(one))
    return x.withColumn("f", F.array(*[F.when(F.col("_t")[i] < 0, -f[i]).otherwise(f[i]) for i in range(width)])).drop("_t")


def column_order(smooth: DataFrame) -> DataFrame:
    """(j, place): stable ascending order of the columns by their statistic."""
    return smooth.select("j", (F.row_number().over(Window.orderBy("smooth", "j")) - 1).alias("place"))  # one row a column


def aligned(nodes: DataFrame, edges: DataFrame, width: int, rank: int) -> DataFrame:
    """Row sums, decomposition (or projection for narrow features), then columns by edge smoothness."""
    from oddgraph.operators.neighbours import smoothness

    x = row_normalised(nodes)
    x = svd_align(x, width, rank) if width > rank else random_projection(x, width, rank)
    order = [r["j"] for r in column_order(smoothness(edges, x, rank)).orderBy("place").collect()]
    return x.withColumn("f", F.array(*[F.col("f")[j] for j in order]))


def class_weights(nodes: DataFrame) -> DataFrame:
    """normal 1, anomaly normals / anomalies; one class only gives null."""
    n0, n1 = F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)
    return nodes.where("mark").agg(n0.alias("normal"), n1.alias("anomaly"), F.when((n0 > 0) & (n1 > 0), n0 / n1).alias("weight"))


def prototypes(nodes: DataFrame, width: int, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Class means of f; a class without members gives zeros."""
    got = nodes.groupBy("y").agg(X.avg_vectors("f", width).alias("c"))
    every = nodes.sparkSession.createDataFrame([(c,) for c in classes], "y int")
    return every.join(got, "y", "left").select("y", F.coalesce("c", X.zeros(width)).alias("c"))


def pca_align(nodes: DataFrame, width: int, rank: int) -> DataFrame:
    """Centred components: the mean is taken away first, then as svd_align."""
    return svd_align(center(nodes, width), width, rank)
