"""Embedding near-dedup: sign hashing in several tables, exact cosine, connected components.

Equal vectors of one label are one representative with a count. Each table hashes a representative by
the signs of ``bits`` random hyperplanes; bits grow with the logarithm of the rows, and the number of
tables follows from the asked recall at the threshold. Inside a bucket all cosines are exact, in
double precision. A pair that meets in several tables is counted in the first of them only, which the
signatures themselves tell, so no pair is ever written: a bucket gives, per row, a number of links and
one edge to the smallest row of its part of the bucket.

Buckets over ``BLOCK`` rows are dealt into blocks and every pair of blocks is a group of its own, so a
bucket that holds a third of all rows is split over many tasks of bounded size.

Defined results: null or zero vectors, vectors with null or non-finite components and rows with a
null label link with nothing; vectors of different lengths are never compared; rows with equal ids
count as rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.llm.common import stored
from oddgraph.llm.components import components

THRESHOLD, RECALL, BUCKET_ROWS, BLOCK, SEED = 0.93, 0.9995, 256, 1024, 11


def tables_for(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): about BUCKET_ROWS rows a bucket, and the asked recall for a pair at the threshold."""
    bits = max(4, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def planes(width: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, bits * tables))


def _linked(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, table: int, threshold: float, same: bool) -> np.ndarray:
    links = a @ b.T >= threshold
    for t in range(table):
        links &= sa[:, t][:, None] != sb[:, t][None, :]
    if same:
        np.fill_diagonal(links, False)
    return links


def _smallest(links: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix the smallest row index of its component."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    v = F.col(vector)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), v.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    reps = stored(rows.where("ok").groupBy("label", "v").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "vectors")
    bits, tables = tables_for(reps.count(), threshold, recall)

    def sign(batches):
        weights = (1 << np.arange(bits, dtype=np.int64))[::-1]
        for batch in batches:
            lists = batch["v"].to_pylist()
            widths = np.array([len(x) for x in lists])
            for width in np.unique(widths):
                mine = np.flatnonzero(widths == width)
                x = np.array([lists[i] for i in mine], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                signs = (x @ planes(int(width), bits, tables) >= 0).reshape(len(x), tables, bits)
                hashed = (signs * weights).sum(axis=2).astype("<i8")
                at = pa.array(np.repeat(mine, tables))
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [batch[c].take(at) for c in ("label", "rep", "copies")]
                    + [pa.array(np.full(n * tables, width, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(hashed.ravel())]
                    + [pa.array([b.tobytes() for b in z], pa.binary()).take(pa.array(np.repeat(np.arange(n), tables))) for z in (hashed, x)],
                    ["label", "rep", "copies", "width", "table", "bucket", "sigs", "unit"],
                )

    kind = rows.schema["label"].dataType.simpleString()
    hashed = reps.mapInArrow(sign, f"label {kind}, rep long, copies long, width int, table int, bucket long, sigs binary, unit binary")
    hashed = stored(hashed, "signed")
    where = ["label", "width", "table", "bucket"]
    sizes = hashed.groupBy(*where).agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    dealt = hashed.join(sizes.select(*where, "blocks"), where).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("bi", F.least("mine", "other")).withColumn("bj", F.greatest("mine", "other"))

    def link(group: pa.Table) -> pa.Table:
        rep, copies, side = (group[c].to_numpy() for c in ("rep", "copies", "mine"))
        table, bi, bj = (group[c][0].as_py() for c in ("table", "bi", "bj"))
        unit = np.frombuffer(b"".join(group["unit"].to_pylist()), np.float64).reshape(len(rep), -1)
        sigs = np.frombuffer(b"".join(group["sigs"].to_pylist()), np.int64).reshape(len(rep), -1)
        i, j = np.flatnonzero(side == bi), np.flatnonzero(side == bj)
        links = _linked(unit[i], unit[j], sigs[i], sigs[j], table, threshold, bi == bj)
        if bi == bj:
            n, at, full = links @ copies[j], i, links
        else:
            at, n = np.concatenate([i, j]), np.concatenate([links @ copies[j], links.T @ copies[i]])
            full = np.zeros((len(at), len(at)), bool)
            full[: len(i), len(i) :] = links
            full[len(i) :, : len(i)] = links.T
        hit = full.any(axis=1)
        if not hit.any():
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        label, ids = _smallest(full), rep[at]
        return pa.table({"rep": pa.array(ids[hit]), "n": pa.array(n[hit].astype(np.int64)), "near": pa.array(ids[label][hit])})

    found = stored(dealt.groupBy(*where, "bi", "bj").applyInArrow(link, "rep long, n long, near long"), "links")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.select("rep", "near")).withColumnRenamed("node", "rep")
    joined = reps.join(linked, "rep", "left").join(parts.withColumnRenamed("label", "part"), "rep", "left").select(
        F.col("label").alias("_l"), F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("part", "rep").alias("component_id")
    )
    out = rows.join(joined, (F.col("ok")) & (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id")
    ).withColumn("kept", F.col(key) == F.col("component_id"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
