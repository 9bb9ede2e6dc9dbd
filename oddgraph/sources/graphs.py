"""Marked attributed graphs: nodes(id, f, y, mark) and edges(src, dst, w), from tables and files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddgraph.functions.exprs import unit

#: Nodes of a strip at least and at most, of a tile, and pairs weighed at a time.
BLOCK, STRIP, TILE, CHUNK = 2048, 1 << 15, 2048, 1 << 17
#: The search for neighbours: nodes of a strip at most, pieces of a strip, rows and columns of a tile, places kept until they are weighed.
WIDE, PIECES, SIDE, HELD = 1 << 16, 16, 1024, 1 << 13
#: More than twice the error of a product of unit vectors in single precision, up to some hundred dimensions.
MARGIN = 1e-4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, f (the embedding), u (its direction), y (label 0 is the anomaly class), g (the label)."""
    f = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), f.alias("f"), (F.col("label") == 0).cast("int").alias("y"), F.col("label").alias("g"))
    return rows.withColumn("u", unit("f"))


def strips(nodes: DataFrame, least: int = BLOCK, most: int = STRIP, about: int = 16) -> int:
    """How many strips of nodes a job over all pairs is cut into: about ``about``, so that the copies of a node
    don't grow with the table, of at least ``least`` nodes and, for memory, at most ``most``."""
    n = nodes.count()
    return max(1, -(-n // min(max(least, -(-n // about)), most)))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(values) else np.empty((len(column), 0))


class _Nearest:
    """The k best of each row so far, by larger weight, then smaller id."""

    def __init__(self, least: np.ndarray, k: int):
        """``least``: what k others reach that are held elsewhere."""
        self.k, self.least, self.w, self.id = k, least.copy(), np.full((len(least), k), -np.inf), np.full((len(least), k), np.iinfo(np.int64).max)
        #: What a product in single precision must reach to be looked at.
        self.floor = (least - MARGIN).astype(np.float32)

    def offer(self, rows: np.ndarray, w: np.ndarray, ids: np.ndarray) -> None:
        at, inverse = np.unique(rows, return_inverse=True)
        place = np.concatenate([inverse, np.repeat(np.arange(len(at)), self.k)])
        w, ids = np.concatenate([w, self.w[at].ravel()]), np.concatenate([ids, self.id[at].ravel()])
        order = np.lexsort((ids, -w, place))
        first = np.searchsorted(place[order], np.arange(len(at)))
        best = order[first[:, None] + np.arange(self.k)]
        self.w[at], self.id[at] = w[best], ids[best]
        self.least[at] = np.maximum(self.w[at, -1], self.least[at])
        self.floor[at] = self.least[at] - MARGIN


def _true(marks: np.ndarray) -> np.ndarray:
    """Places of the true entries, which are few: eight neighbours are passed over at a time, and eight of these that lie
    evenly apart, so that whole rows are put together."""
    whole = len(marks) // 64 * 64
    eight = marks[:whole].view(np.uint64)
    apart = eight.reshape(8, -1)
    some = np.flatnonzero(np.bitwise_or.reduce(apart, axis=0))
    row, near = np.nonzero(apart[:, some])
    near = row * apart.shape[1] + some[near]
    near = (8 * near[:, None] + np.arange(8))[eight[near].view(bool).reshape(-1, 8)]
    return np.concatenate([near, whole + np.flatnonzero(marks[whole:])])


def _reached(sims: np.ndarray, k: int, groups: int = 128) -> np.ndarray:
    """What k entries of each row reach at least: the k-th largest of the maxima of groups of columns."""
    each = sims.shape[1] // groups
    if each:
        sims = sims[:, : each * groups].reshape(len(sims), each, groups).max(axis=1) if sims.flags.c_contiguous else sims.T[: each * groups].reshape(each, groups, len(sims)).max(axis=0).T
    return np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] >= k else np.full(len(sims), -np.inf, sims.dtype)


def _above(sims: np.ndarray, floors: list[np.ndarray], mark: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places (own row, other row) of the products that reach the floor of their row and, with a second array, of their
    column. One pass marks what reaches the least floor of all, unless that is much of the tile."""
    low = min(f.min() for f in floors)
    if 256 * np.count_nonzero(sims[::64] >= low) < sims[::64].size:
        found = _true(np.greater_equal(sims, low, out=mark).ravel())
        r, q = np.divmod(found, sims.shape[1])
        w = sims[r, q]
        each = [found[w >= f[x]] for f, x in zip(floors, (r, q), strict=False)]
    else:
        each = [_true(np.greater_equal(sims, f, out=mark).ravel()) for f in (floors[0][:, None], *floors[1:])]
    places = [np.divmod(x, sims.shape[1]) for x in each]
    return [x if not turned else x[::-1] for turned, x in enumerate(places)]


def _weigh(ids: list[np.ndarray], u: list[np.ndarray], h: list[np.ndarray] | None, least: list[np.ndarray], k: int, radius: float | None) -> list[_Nearest]:
    """The k best of each row of two strips against the other, or of one strip against itself."""
    alone, two = len(u) == 1, len(u) - 1
    square, held, short = [np.einsum("ij,ij->i", x, x) for x in u], [_Nearest(x, k) for x in least], [x.astype(np.float32) for x in u]
    turned = [np.ascontiguousarray(short[two][c : c + SIDE].T) for c in range(0, len(u[two]), SIDE)]
    products, marks = np.empty(SIDE * SIDE, np.float32), np.empty(SIDE * SIDE, bool)  # filled anew for each tile
    places, kept = [[] for _ in u], [0] * len(u)  # (own row, other row) to be weighed, for each strip

    def weigh(me: int) -> None:
        rows, others = (np.concatenate(x) for x in zip(*places[me], strict=True))
        it, kept[me] = two - me, 0
        places[me].clear()
        for p in range(0, len(rows), CHUNK):
            s, d = rows[p : p + CHUNK], others[p : p + CHUNK]
            w = np.round(np.einsum("ij,ij->i", u[me][s], u[it][d]), 12)
            real = (ids[me][s] != ids[it][d]) & (w >= held[me].least[s])
            if h is not None:
                real &= (h[me][s] == h[it][d]).any(axis=1) & (square[me][s] + square[it][d] - 2 * w < radius**2)
            if real.any():
                held[me].offer(s[real], w[real], ids[it][d[real]])

    for a in range(0, len(u[0]), SIDE):
        rows = slice(a, min(a + SIDE, len(u[0])))
        for c in range(a if alone else 0, len(u[two]), SIDE):
            cols = slice(c, min(c + SIDE, len(u[two])))
            shape = (rows.stop - a, cols.stop - c)
            sims, mark = (x[: shape[0] * shape[1]].reshape(shape) for x in (products, marks))
            np.matmul(short[0][rows], turned[c // SIDE], out=sims)
            ways, floors = [(sims, (0, rows), (two, cols))], []
            if not alone or a < c:  # a tile on the diagonal holds each of its pairs twice
                ways.append((sims.T, (two, cols), (0, rows)))
            for x, (me, mine), (it, its) in ways:
                floor = held[me].floor[mine]
                if np.isneginf(floor.min()):
                    first = x if h is None else np.where((h[me][mine, None] == h[it][None, its]).any(axis=2), x, -np.inf)
                    floor = np.maximum(floor, _reached(first, k + 1) - MARGIN)  # the row itself may be among the best
                if h is not None:
                    floor = np.maximum(floor, ((square[me][mine] + square[it][its].min() - radius**2) / 2 - MARGIN).astype(np.float32))
                floors.append(floor)
            for (_, (me, mine), (it, its)), (r, q) in zip(ways, _above(sims, floors, mark), strict=True):
                places[me].append((r + mine.start, q + its.start))
                kept[me] += len(r)
                if kept[me] >= HELD:
                    weigh(me)
    for me, found in enumerate(places):
        if found:
            weigh(me)
    return held


def _found(ids: np.ndarray, best: _Nearest, part: slice) -> dict[str, bytes]:
    """What some of the rows hold, as bytes."""
    w = best.w[part].ravel()
    real = np.isfinite(w)
    return {"src": np.repeat(ids[part], best.k)[real].tobytes(), "dst": best.id[part].ravel()[real].tobytes(), "w": w[real].tobytes()}


def _own(strip: pa.Table, k: int, radius: float | None) -> Iterator[pa.RecordBatch]:
    """The finite vectors of a strip, a piece to a row as bytes, with what is found within the strip and the least of it."""
    u, q, ids = matrix(strip["u"]).astype(float), strip["q"].to_numpy(), strip["id"].to_numpy().astype(np.int64)
    order = np.argsort(q, kind="stable")
    order = order[np.isfinite(u).all(axis=1)[order]]
    if not len(order):
        return
    u, q, ids, h = u[order], q[order], ids[order], None if radius is None else matrix(strip["h"]).astype(float)[order]
    best = _weigh([ids], [u], None if h is None else [h], [np.full(len(u), -np.inf)], k, radius)[0]
    for piece in np.unique(q):
        part = slice(*np.searchsorted(q, [piece, piece + 1]))
        held = {"ids": ids[part], "u": u[part], "least": best.w[part, -1]} | ({} if h is None else {"h": h[part]})
        yield pa.RecordBatch.from_pydict({"q": pa.array([piece], pa.int32())} | {c: [x] for c, x in ({c: x.tobytes() for c, x in held.items()} | _found(ids, best, part)).items()})


def _pair(pieces: list[dict], k: int, radius: float | None) -> Iterator[pa.RecordBatch]:
    """What is found between two strips, a row a piece; what was found within a strip is passed on."""
    own, sides = [r for r in pieces if r["w"] is not None], [[r for r in pieces if r["w"] is None and r["left"] == x] for x in (True, False)]
    for r in own:
        yield pa.RecordBatch.from_pydict({"q": pa.array([r["q"]], pa.int32())} | {c: [r[c]] for c in ("src", "dst", "w")})
    if not all(sides):
        return
    read = lambda c, kind=float: [np.concatenate([np.frombuffer(r[c], kind) for r in x]) for x in sides]
    ids, least = read("ids", np.int64), read("least")
    u, h = ([x.reshape(len(i), -1) for x, i in zip(read(c), ids, strict=True)] if c in pieces[0] else None for c in ("u", "h"))
    for i, x, best in zip(ids, sides, _weigh(ids, u, h, least, k, radius), strict=True):
        ends = np.cumsum([0, *(len(r["ids"]) // 8 for r in x)])
        for r, start, stop in zip(x, ends[:-1], ends[1:], strict=True):
            yield pa.RecordBatch.from_pydict({"q": pa.array([r["q"]], pa.int32())} | {c: [v] for c, v in _found(i, best, slice(start, stop)).items()})


def _merged(group: pa.Table, k: int) -> pa.Table:
    """The k best of each row of a piece over what the tasks found."""
    src, dst, w = (np.concatenate([np.frombuffer(v.as_buffer(), t) for v in group[c]]) for c, t in (("src", np.int64), ("dst", np.int64), ("w", float)))
    order = np.lexsort((dst, -w, src))
    order = order[np.isfinite(w[order])]
    kept = order[np.arange(len(order)) - np.searchsorted(src[order], src[order]) < k]
    return pa.table({"src": src[kept], "dst": dst[kept], "w": w[kept]})


def knn_edges(nodes: DataFrame, k: int = 5, block: int = BLOCK, radius: float | None = None) -> DataFrame:
    """Exact cosine k nearest neighbours, self excluded, ties by id. With a radius only pairs at a distance below it
    count that share a bucket, an equal entry at one place of the nodes' arrays h.

    Nodes are dealt into strips. A task a strip finds the neighbours within it and packs its pieces into one row each;
    then every unordered pair of strips is one task of bounded size that serves both of its strips and looks for what
    reaches a row's k best so far; what was found for a piece is merged by one group. A task multiplies tiles in single
    precision, and what may reach a row's k best by that is weighed in double precision.
    """
    count = strips(nodes, block, WIDE)
    more = ["h"] if radius is not None else []
    dealt = nodes.where("u is not null and id is not null").select("id", "u", *more, F.pmod(F.xxhash64("id"), F.lit(count * PIECES)).cast("int").alias("q"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield from _own(pa.Table.from_batches(held), k, radius)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [r for batch in batches for r in batch.to_pylist()]:
            yield from _pair(held, k, radius)

    # One partition a strip and one a pair, by their numbers: these few bytes are minutes of work and not to be put together.
    kept, found = ["ids", "u", "least", *more], ["src", "dst", "w"]
    pieces = dealt.repartitionById(count, F.expr(f"q div {PIECES}").cast("int")).mapInArrow(own, "q int, " + ", ".join(f"{c} binary" for c in kept + found))
    strip, other = F.expr(f"q div {PIECES}").cast("int"), F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    both = pieces.withColumn("b", strip).withColumn("o", other).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")})
    within = F.col("i") == F.col("j")
    pairs = both.select(
        "q", (F.col("b") == F.col("i")).alias("left"), (F.expr("j * (j + 1) div 2") + F.col("i")).cast("int").alias("p"), *[F.when(~within, F.col(c)).alias(c) for c in kept], *[F.when(within, F.col(c)).alias(c) for c in found]
    )
    every = pairs.repartitionById(count * (count + 1) // 2, "p").drop("p").mapInArrow(pair, "q int, " + ", ".join(f"{c} binary" for c in found))
    return every.groupBy("q").applyInArrow(lambda group: _merged(group, k), "src long, dst long, w double")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts (2k) and suppliers (2k + 1), both directions, weighted by quantity."""
    w = table(spark, sf_dir, "lineitem").groupBy((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).agg(F.sum("l_quantity").alias("w"))
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))  # from one aggregate, not two
    return w.select(F.explode(ways).alias("e"), "w").select("e.src", "e.dst", "w")


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select((2 * F.col("p_partkey")).alias("id"), F.array(F.col("p_retailprice") / 997.3, F.col("p_size") / 7.123).alias("f"))
    supplier = table(spark, sf_dir, "supplier").select((2 * F.col("s_suppkey") + 1).alias("id"), F.array(F.col("s_acctbal") / 997.3, F.lit(1 / 7.123)).alias("f"))
    return part.union(supplier).withColumn("y", (F.col("id") % 10 == 0).cast("int"))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked are the documents that have a label; the anomaly class is ``toxic``. No text is read."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return docs.join(labels, docs["id"] == labels["doc_id"], "left").select("id", "lang", "source", "n_chars", "y", F.col("y").isNotNull().alias("mark"))


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer, directed: ids 1e6 + region, 2e6 + nation, 3e6 + customer."""
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1_000_000).cast("long").alias("src"), (F.col("n_nationkey") + 2_000_000).cast("long").alias("dst"))
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 2_000_000).cast("long").alias("src"), (F.col("c_custkey") + 3_000_000).cast("long").alias("dst"))
    return n.union(c)


def csv_graph(classes: DataFrame, features: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph from its three tables: classes(ext, class), features(ext, f), pairs(a, b).

    Class "1" is the anomaly, "unknown" is not marked. External ids become row numbers in id order by
    counted ranges, so no global sort of wide rows is needed.
    """
    ids = row_numbers(features.select("ext"), "ext")
    nodes = features.join(ids, "ext").join(classes, "ext", "left").select(
        "id", "f", (F.col("class") == "1").cast("int").alias("y"), (F.coalesce("class", F.lit("unknown")) != "unknown").alias("mark")
    )
    a, b = (ids.select(F.col("ext").alias(x), F.col("id").alias(y)) for x, y in (("a", "src"), ("b", "dst")))
    return nodes, pairs.join(a, "a").join(b, "b").select("src", "dst", F.lit(1.0).alias("w"))


def row_numbers(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """0-based numbers in key order: ranks within ranges of the key plus the ranges' offsets. The ranges are
    cut at keys of a bounded hashed sample, so keys of any type do."""
    sample = sorted({r[0] for r in rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(64 * parts).collect()})
    cuts = sample[:: max(1, len(sample) // parts)]
    which = F.lit(0)
    for i, c in enumerate(cuts):
        which = F.when(F.col(key) > c, i + 1).otherwise(which)
    dealt = rows.withColumn("_p", which)
    counts = dealt.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_o"))  # one row a range
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return dealt.withColumn("_r", rank).join(F.broadcast(offsets), "_p").select(key, (F.col("_r") + F.col("_o") - 1).cast("long").alias("id"))


def npz_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph from a NumPy archive with x, y, edge_index and optional split index arrays, whose
    union marks the nodes (all are marked without them). For converting single files to Parquet."""
    held = np.load(path)
    n = len(held["x"])
    mark = np.ones(n, bool)
    splits = [held[k] for k in ("train_mask", "valid_mask", "test_mask") if k in held.files]
    if splits:
        mark[:] = False
        for s in splits:
            mark[np.flatnonzero(s) if s.dtype == bool else s] = True
    nodes = pa.table({"id": np.arange(n), "f": held["x"].astype(float).tolist(), "y": (held["y"] == 1).astype(np.int32), "mark": mark})
    e = held["edge_index"].astype(np.int64)
    return spark.createDataFrame(nodes), spark.createDataFrame(pa.table({"src": e[:, 0], "dst": e[:, 1], "w": np.ones(len(e))}))


def demo_graph(spark: SparkSession, n: int = 128, width: int = 16, anomalies: int = 24, density: float = 0.06) -> tuple[DataFrame, DataFrame]:
    """A ring with random undirected edges; the last nodes are shifted. Noise comes from keyed hashes."""
    from oddgraph.functions.exprs import uniform

    odd = F.col("id") >= n - anomalies
    nodes = spark.range(n).select("id", F.array(*[uniform(j, "id") - 0.5 + F.when(odd, 1.5).otherwise(0.0) for j in range(width)]).alias("f"), odd.cast("int").alias("y"), F.lit(True).alias("mark"))
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    other = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n))).alias("dst")).where((F.col("dst") < n) & (uniform(99, "src", "dst") < density))
    one = ring.union(other)
    return nodes, one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1.0))
