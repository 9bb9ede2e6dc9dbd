"""Seeded samples and splits. Order comes from md5 of the seed and the ids, so it depends neither on
partitions nor on row order; prefixes of larger samples contain those of smaller ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddgraph.functions.exprs import ordered_key, uniform


def ranked(nodes: DataFrame, seed: int, by: list[str] | None = None, name: str = "r") -> DataFrame:
    """1-based rank in shuffle order, per group of ``by``. The first three digits of the key cut the order
    into 4096 even ranges: rows are sorted within a range, and a window runs over the ranges' counts."""
    by, key = by or [], ordered_key(seed, "id")
    dealt = nodes.withColumn("_k", key).withColumn("_d", F.substring("_k", 1, 3))
    counts = dealt.groupBy(*by, "_d").agg(F.count("*").alias("_c"))
    over = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_d").alias("_e"), F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_o"))
    x = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_d").orderBy("_k", "id")))
    same = F.col("_d") == F.col("_e")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return x.join(starts, same).select(*[c for c in nodes.columns if c != name], (F.col("_r") + F.col("_o")).alias(name))


def prefix(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """The first k in shuffle order by a bounded top-k, not a global sort."""
    return nodes.orderBy(ordered_key(seed, "id"), "id").limit(k)


def holdout(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """Label-blind: k marked nodes are support, the other marked ones query."""
    support = prefix(nodes.where("mark"), k, seed).select("id")
    marked = nodes.where("mark").select("id", "y")
    role = F.when(F.col("_s").isNotNull(), "support").otherwise("query")
    return marked.join(support.withColumn("_s", F.lit(1)), "id", "left").select("id", "y", role.alias("role"))


def check_holdout(split: DataFrame) -> None:
    """Raise if the query lacks a class; a split is never drawn again."""
    classes = split.where("role = 'query'").agg(F.count_distinct("y").alias("c")).first()["c"]
    if classes < 2:
        raise ValueError("the query holds one class only")


def per_class(nodes: DataFrame, k: int, seed: int, strict: bool = False) -> DataFrame:
    """k of each class; a class of fewer repeats its members in turn unless strict, which raises."""
    pool = ranked(nodes.where("mark and y in (0, 1)"), seed, ["y"]).select("id", "y", "r")
    sizes = pool.groupBy("y").agg(F.count("*").alias("size"))  # two rows
    if strict and (sizes.where(F.col("size") < k).count() or sizes.count() < 2):
        raise ValueError("a class is smaller than the shot")
    slots = sizes.select("y", "size", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    wanted = slots.select("y", "slot", (F.col("slot") % F.col("size") + 1).cast("int").alias("r"))
    return wanted.join(pool, ["y", "r"]).select("y", "slot", "id")


def per_class_reserving(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """As per_class, but a class of at most k members first gives one node, the first of a second
    shuffle, to the query; classes of fewer than two members are left out."""
    pool = nodes.where("mark and y in (0, 1)").select("id", "y")
    sizes = pool.groupBy("y").agg(F.count("*").alias("size")).where("size >= 2")
    first = ranked(pool, seed + 1, ["y"], "q").join(F.broadcast(sizes), "y")
    rest = first.where(~((F.col("size") <= k) & (F.col("q") == 1))).select("id", "y", F.lit(True).alias("mark"))
    return per_class(rest, k, seed)


def normal_context(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """k marked normals as context; the rest of the marked nodes is the query."""
    support = prefix(nodes.where("mark and y = 0"), k, seed).select("id", F.lit("context").alias("_r"))
    return nodes.where("mark").select("id", "y").join(support, "id", "left").select("id", "y", F.coalesce("_r", F.lit("query")).alias("role"))


def random_context(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    return prefix(nodes.where("mark"), k, seed)


def episode(nodes: DataFrame, k: int, query: tuple[int, int], seed: int) -> DataFrame:
    """k of each class as support, then at most query[0] normals and query[1] anomalies as query."""
    r = ranked(nodes.where("mark and y in (0, 1)"), seed, ["y"])
    most = k + F.when(F.col("y") == 0, query[0]).otherwise(query[1])
    return r.where(F.col("r") <= most).select("id", "y", F.when(F.col("r") <= k, "support").otherwise("query").alias("role"))


def stratified(nodes: DataFrame, seed: int, train: float = 0.3, valid: float = 0.1) -> DataFrame:
    """Per class, floor shares by shuffle rank."""
    marked = nodes.where("mark")
    counts = marked.groupBy("y").agg(F.count("*").alias("n"))  # one row a class
    r = ranked(marked, seed, ["y"]).join(counts, "y")
    a, b = F.floor(train * F.col("n")), F.floor((train + valid) * F.col("n"))
    return r.select("id", "y", F.when(F.col("r") <= a, "train").when(F.col("r") <= b, "valid").otherwise("test").alias("part"))


def train_rate(nodes: DataFrame, rate: float, seed: int) -> DataFrame:
    """Ids of the first int(rate N) of all N nodes in shuffle order."""
    return ranked(nodes.select("id"), seed).where(F.col("r") <= int(rate * nodes.count())).select("id")


def context_and_query(nodes: DataFrame, context: int, per_class: int, seed: int) -> DataFrame:
    """(id, y, role): the first ``context`` marked normals, then a query of as many normals as anomalies, disjoint
    from the context: ``per_class`` of each, or as many as the smaller class has left."""
    pool = nodes.where("mark and y in (0, 1)").select("id", "y")
    n = pool.agg(F.count_if(F.col("y") == 0).alias("normal"), F.count_if(F.col("y") == 1).alias("anomaly")).first()
    m = max(0, min(per_class, n["normal"] - context, n["anomaly"]))
    taken = F.when(F.col("y") == 0, context).otherwise(0)
    role = F.when(F.col("r") <= taken, "context").when(F.col("r") <= taken + m, "query")
    return ranked(pool, seed, ["y"]).withColumn("role", role).where("role is not null").select("id", "y", "role")


def source_batches(nodes: DataFrame, context: int, per_class: int, steps: int, seed: int) -> DataFrame:
    """(step, graph, id, y, role): for each step a graph drawn from those of nodes(graph, id, y, mark) and, of it, a
    context of normals and a balanced query disjoint from it.

    Nodes are ranked once, by graph and class; a step takes consecutive ranks from a hashed place on, around
    the end, so a step reads what it takes. Of a class that is too small the query has fewer, of both classes
    as many; graphs without both classes, or without normals left for the query, are never drawn.
    """
    pool = nodes.where("mark and y in (0, 1)").select("graph", "id", "y")
    sizes = pool.groupBy("graph").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).where((F.col("n0") > context) & (F.col("n1") > 0))
    sizes = sizes.withColumn("g", F.row_number().over(Window.orderBy("graph")) - 1)  # one row a graph
    count = sizes.agg(F.count("*").alias("graphs"))  # one row
    step = nodes.sparkSession.range(steps).select(F.col("id").alias("step")).crossJoin(F.broadcast(count)).withColumn("g", F.floor(uniform(seed, "step") * F.col("graphs")).cast("int"))
    m = F.least(F.lit(per_class), F.col("n0") - context, F.col("n1"))
    takes = step.join(sizes, "g").withColumn("y", F.explode(F.array(F.lit(0), F.lit(1))))
    n, most = F.when(F.col("y") == 0, F.col("n0")).otherwise(F.col("n1")), F.when(F.col("y") == 0, context + m).otherwise(m)
    takes = takes.where(most > 0).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), most.cast("long"))))
    start = F.floor(uniform(seed + 1, "step", "y") * n).cast("long")
    takes = takes.select("step", "graph", "y", "j", (F.pmod(start + F.col("j") - 1, n) + 1).alias("r"))
    role = F.when((F.col("y") == 0) & (F.col("j") <= context), "context").otherwise("query")
    return takes.join(ranked(pool, seed, ["graph", "y"]), ["graph", "y", "r"]).select("step", "graph", "id", "y", role.alias("role"))


def edge_dropout(e: DataFrame, p: float, seed: int) -> DataFrame:
    """Edges go with probability p; loops stay."""
    return e.where((uniform(seed, "src", "dst") >= p) | (F.col("src") == F.col("dst")))


def truncated(dist: DataFrame, seed: int) -> DataFrame:
    """Per node a threshold between the mean and its largest distance; edges beyond it are proposed for
    cutting, and an edge stays if either end keeps it. dist(src, dst, dist) holds both directions."""
    mean = dist.where("dist <> 0").agg(F.avg("dist").alias("mu"))  # one row
    top = dist.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("top"))
    cuts = top.crossJoin(F.broadcast(mean)).select("id", F.when(F.col("top") > F.col("mu"), F.col("mu") + uniform(seed, "id") * (F.col("top") - F.col("mu"))).otherwise(F.col("top")).alias("t"))
    kept = dist.join(cuts.withColumnRenamed("id", "src"), "src").where("dist <= t").select("src", "dst")
    return kept.union(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def random_walk_sample(e: DataFrame, nodes: DataFrame, size: int, seed: int) -> DataFrame:
    """size - 1 out-neighbours with replacement and the node itself; an isolated node draws itself."""
    return random_walk_rounds(e, nodes, size, [seed]).drop("round")


def drawn_rank(k: str, turn: Column, node: str, slot: Column) -> Column:
    """Which of a node's k out-neighbours, from 1 in the order of their ids, is drawn for a slot of a round."""
    key = F.md5(F.concat_ws(":", *[c.cast("string") for c in (turn, F.col(node), slot)]))
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col(k)).cast("int") + 1


def random_walk_rounds(e: DataFrame, nodes: DataFrame, size: int, seeds: list[int]) -> DataFrame:
    """(id, round, slot, node): the sample for each seed as a round, all in one join."""
    w = Window.partitionBy("src")
    r = e.select("src", "dst", F.row_number().over(w.orderBy("dst")).alias("r"))
    k = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    rounds = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("round")
    draws = nodes.select("id").join(k, "id", "left").na.fill(0, ["k"]).select("id", "k", rounds).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    pick = drawn_rank("k", F.col("round"), "id", F.col("slot"))
    draws = draws.withColumn("r", F.when((F.col("slot") > 0) & (F.col("k") > 0), pick).otherwise(0))
    got = draws.join(r.withColumnRenamed("src", "id"), ["id", "r"], "left")
    return got.select("id", "round", "slot", F.coalesce("dst", "id").alias("node"))


def _free_places(taken: DataFrame, starts: DataFrame, n: int, k: int) -> DataFrame:
    """(q, slot, place): the first min(k, free) places of a circle of n that query q's walk from place ``s``
    meets and that are not taken. taken(q, place) is distinct, starts(q, s).

    In walking order the j-th taken place (from 1) at offset o has o - (j - 1) free ones before it, so the i-th
    free offset is i - 1 plus the number of taken places with o - (j - 1) <= i - 1. Only offsets below k plus the
    number of taken places can matter; they are numbered within ranges of offsets, and a query keeps k counts.
    """
    span = 1 << 16
    m = taken.groupBy("q").agg(F.count("*").alias("m"))
    near = taken.join(starts, "q").join(m, "q").select("q", F.pmod(F.col("place") - F.col("s"), F.lit(n)).alias("o"), "m").where(F.col("o") < F.col("m") + k)
    near = near.select("q", "o", F.floor(F.col("o") / span).alias("part"))
    parts = near.groupBy("q", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("q", "part").orderBy("o")) - 1
    free = near.withColumn("i", inside).join(parts.withColumn("before", before).drop("c"), ["q", "part"]).select("q", (F.col("o") - F.col("i") - F.col("before")).alias("free"))
    counts = free.where(F.col("free") < k).groupBy("q", "free").agg(F.count("*").alias("c"))
    counts = counts.groupBy("q").agg(F.collect_list(F.struct("free", "c")).alias("counts"))  # at most k of them
    x = starts.join(m, "q", "left").join(counts, "q", "left").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k))))
    passed = F.aggregate(F.coalesce("counts", F.array().cast("array<struct<free: bigint, c: bigint>>")), F.lit(0).cast("long"), lambda t, c: t + F.when(c["free"] < F.col("slot"), c["c"]).otherwise(0))
    x = x.where(F.col("slot") <= n - F.coalesce("m", F.lit(0)))
    return x.select("q", "slot", F.pmod(F.col("s") + F.col("slot") - 1 + passed, F.lit(n)).alias("place"))


def _circle(nodes: DataFrame, seed: int) -> DataFrame:
    """(cand, place): the nodes in shuffle order, from 0."""
    return ranked(nodes.select("id"), seed).select(F.col("id").alias("cand"), (F.col("r") - 1).alias("place"))


def non_neighbours(e: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, slot, cand): min(k, available) distinct nodes that are neither an out-neighbour nor the node itself.

    Nodes lie on a circle in shuffle order, and each node walks it from a hashed place; what it meets is
    computed from its taken places alone, whether it has few neighbours or nearly all nodes.
    """
    n = nodes.count()
    circle = _circle(nodes, seed)
    ends = e.select(F.col("src").alias("q"), F.col("dst").alias("cand")).union(nodes.select(F.col("id").alias("q"), F.col("id").alias("cand"))).distinct()
    starts = nodes.select(F.col("id").alias("q"), F.floor(uniform(seed + 1, "id") * n).cast("long").alias("s"))
    found = _free_places(ends.join(circle, "cand").select("q", "place"), starts, n, k)
    return found.join(circle, "place").select(F.col("q").alias("id"), "slot", "cand")


def triplets(e: DataFrame, nodes: DataFrame, count: int, k: int, seed: int, strict: bool = True) -> DataFrame:
    """(anchor, positive, slot, negative): the first ``count`` edges without loops in shuffle order, and k distinct
    non-neighbours of each edge's anchor, drawn anew for every edge. With ``strict`` an anchor that has fewer
    than k raises ValueError; otherwise it gives what it has."""
    n = nodes.count()
    circle = _circle(nodes, seed)
    real = e.where("src <> dst").select("src", "dst").distinct()
    chosen = ranked(real.select(F.concat_ws(":", "src", "dst").alias("id"), "src", "dst"), seed).where(F.col("r") <= count).select("r", "src", "dst")
    mine = chosen.select(F.col("r").alias("q"), "src").join(real, "src").select("q", F.col("dst").alias("cand"))
    ends = mine.union(chosen.select("r", "src"))
    starts = chosen.select(F.col("r").alias("q"), F.floor(uniform(seed + 1, "src", "dst") * n).cast("long").alias("s"))
    found = _free_places(ends.join(circle, "cand").select("q", "place"), starts, n, k).join(circle, "place")
    out = chosen.join(found.select(F.col("q").alias("r"), "slot", F.col("cand").alias("negative")), "r", "left").select(F.col("src").alias("anchor"), F.col("dst").alias("positive"), "slot", "negative")
    if strict:
        short = out.groupBy("anchor", "positive").agg(F.count("negative").alias("c")).where(F.col("c") < k).select("anchor").first()
        if short is not None:
            raise ValueError(f"node {short['anchor']} has fewer than {k} non-neighbours")
    return out.where("negative is not null")


def node_pairs(nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """Uniform pairs by place in id order; for graphs whose ids are 0..n-1 the place is the id."""
    n = nodes.count()
    s = nodes.sparkSession.range(count).withColumnRenamed("id", "pair")
    a, b = (F.floor(uniform(x, "pair") * n).cast("long") for x in (seed, seed + 1))
    return s.select("pair", a.alias("a"), b.alias("b"))


def columns_sample(width: int, count: int, seed: int, spark) -> DataFrame:
    """Columns with replacement; each stands for width / count columns."""
    s = spark.range(count).withColumnRenamed("id", "slot")
    return s.select("slot", F.floor(uniform(seed, "slot") * width).cast("long").alias("j"), F.lit(width / count).alias("scale"))


def negative_in_batch(nodes: DataFrame, batch: int) -> DataFrame:
    """The element before in a logical batch; the first takes the last but one, a singleton itself."""
    w = Window.partitionBy("b").orderBy("id")
    x = nodes.select("id", F.floor(F.col("id") / batch).alias("b"))
    n, prev = F.count("*").over(Window.partitionBy("b")), F.lag("id").over(w)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last_but_one = F.element_at(F.collect_list("id").over(whole), F.greatest(n - 1, F.lit(1)).cast("int"))
    return x.select("id", F.coalesce(prev, last_but_one).alias("negative"))
