"""Ranking metrics and reports. Higher scores are more anomalous; ties are ordered by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_score(scores: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    return scores.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))


def before(rows: DataFrame, sums: list[str], order: str = "score", by: list[str] | None = None, desc: bool = False, cells: int = 65536) -> DataFrame:
    """Adds _s for each s of ``sums``: its sum over the rows that come earlier in the order of a numeric column.

    The span of the column is cut into equal cells: rows are sorted within their cell only, and one
    window runs over the sums per cell, at most ``cells`` rows a group. Nulls come first and NaN last.
    """
    by, way, o = by or [], F.desc if desc else F.asc, F.col(order).cast("double")
    span = rows.agg(F.min(o).alias("_lo"), F.max(o).alias("_hi"))  # one row
    at = F.when(F.col("_hi") > F.col("_lo"), (o - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    cell = F.when(o.isNull(), -1).when(F.isnan(o), cells + 1).when((at >= 0) & (at <= 1), F.floor(at * cells)).otherwise(0)
    dealt = rows.crossJoin(F.broadcast(span)).withColumn("_cell", cell.cast("int")).drop("_lo", "_hi")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = earlier(Window.partitionBy(*by).orderBy(way("_cell")))
    whole = dealt.groupBy(*by, "_cell").agg(*[F.sum(s).alias(s) for s in sums]).select(*by, "_cell", *[F.coalesce(F.sum(s).over(over), F.lit(0)).alias(f"_w{s}") for s in sums])
    inside = earlier(Window.partitionBy(*by, "_cell").orderBy(way(order)))
    x = dealt.withColumns({f"_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).join(whole, [*by, "_cell"])
    return x.select(*rows.columns, *[(F.col(f"_{s}") + F.col(f"_w{s}")).alias(f"_{s}") for s in sums])


def smallest(rows: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The first k rows in the order of numeric columns, which tell rows apart, however large k is.

    Column by column, rows are counted by value, and the running counts tell the value at which the k-th row
    lies: smaller values are taken whole, and only rows of that value go on to the next column. Read the
    rows from a table: each column reads them again.
    """
    out = rows.where("false")
    for c in order:
        counts = before(rows.groupBy(c).agg(F.count("*").alias("n")), ["n"], c)
        edge = counts.where((F.col("_n") < k) & (F.col("_n") + F.col("n") >= k)).select(c, "_n", "n").first()
        if edge is None:  # fewer than k rows, or none wanted
            return out.union(rows) if k > 0 else out
        out = out.union(rows.where(F.col(c) < F.lit(edge[c])))
        rows, k = rows.where(F.col(c) == F.lit(edge[c])), k - edge["_n"]
        if edge["n"] == k:
            return out.union(rows)
    return out.union(rows)


def auroc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Over scores(score, y in 0/1): sum of p (negatives below + half of those tied) / (P N); one class only gives null."""
    by = by or []
    x = before(_by_score(scores, by), ["n"], by=by)
    total = F.sum("p") * F.sum("n")
    return x.groupBy(*by).agg(F.when(total > 0, F.sum(F.col("p") * (F.col("_n") + 0.5 * F.col("n"))) / total).alias("auroc"))


def average_precision(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    x = before(_by_score(scores, by), ["p", "n"], by=by, desc=True)
    tp, fp = F.col("p") + F.col("_p"), F.col("n") + F.col("_n")
    return x.groupBy(*by).agg(F.when(F.sum("p") > 0, F.sum(F.when(F.col("p") > 0, F.col("p") * tp / (tp + fp)).otherwise(0.0)) / F.sum("p")).alias("auprc"))


def recall_at_k(scores: DataFrame) -> DataFrame:
    """Share of the anomalies among the first K rows by (score descending, id), K their count; K = 0 gives NaN.

    The K-th largest score is found on counts per score; ids are ranked only among the rows tied with it.
    """
    counts = scores.groupBy("score").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    total = counts.agg(F.sum("p").alias("K"))  # one row
    x = before(counts, ["n"], desc=True).crossJoin(F.broadcast(total))
    full = x.where(F.col("_n") + F.col("n") <= F.col("K")).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("whole"))
    edge = x.where((F.col("_n") < F.col("K")) & (F.col("_n") + F.col("n") > F.col("K"))).select("score", (F.col("K") - F.col("_n")).alias("room"))  # one row
    tied = before(scores.join(F.broadcast(edge), "score").select("id", "y", "room", F.lit(1).alias("one")), ["one"], "id")
    part = tied.where("_one < room").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("part"))
    return total.crossJoin(full).crossJoin(part).select(F.when(F.col("K") > 0, (F.col("whole") + F.col("part")) / F.col("K")).otherwise(float("nan")).alias("recall_at_k"))


METRICS = {"standard": ("auroc", "auprc"), "recall-at-k": ("recall_at_k",), "all": ("auroc", "auprc", "recall_at_k")}


def evaluate(scores: DataFrame, mode: str = "standard") -> DataFrame:
    """One row with the metrics of a mode, over rows with mark; unmarked rows are ignored."""
    x = scores.where("mark").select("id", "score", F.col("y").cast("int").alias("y")) if "mark" in scores.columns else scores
    parts = {"auroc": auroc, "auprc": average_precision, "recall_at_k": recall_at_k}
    out = None
    for name in METRICS[mode]:
        one = parts[name](x)
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


def not_evaluable(scores: DataFrame) -> DataFrame:
    """Counts of marked rows that forbid evaluation: labels outside {0, 1}, null or non-finite scores."""
    s = F.col("score")
    return scores.where("mark").agg(
        F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("bad_labels"), F.count_if(s.isNull() | F.isnan(s) | F.abs(s).isin(float("inf"))).alias("bad_scores")
    )


def seed_summary(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation over seeds, rounded to 4, and their count; no value gives NaN."""
    cols = []
    for m in metrics:
        cols += [F.coalesce(F.round(F.avg(m), 4), F.lit(float("nan"))).alias(f"{m}_mean"), F.coalesce(F.round(F.stddev_pop(m), 4), F.lit(float("nan"))).alias(f"{m}_std")]
    return rows.groupBy(*by).agg(*cols, F.count(metrics[0]).alias("n"))


def mode_delta(rows: DataFrame, metric: str) -> DataFrame:
    """single and multi side by side, and multi - single rounded to 4 (null if either is absent)."""
    keys = ["method", "src_type", "tgt_type", "target"]
    wide = rows.groupBy(*keys).pivot("mode", ["single", "multi"]).agg(F.first(metric))
    return wide.select(*keys, F.col("single").alias(f"single_{metric}"), F.col("multi").alias(f"multi_{metric}"), F.round(F.col("multi") - F.col("single"), 4).alias("delta"))


def paired_macro(delta: DataFrame, metric: str) -> DataFrame:
    """Per method the means over targets that have both modes."""
    s, m = f"single_{metric}", f"multi_{metric}"
    both = delta.where(F.col(s).isNotNull() & F.col(m).isNotNull())
    return both.groupBy("method").agg(F.avg(s).alias("single"), F.avg(m).alias("multi"), F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("method", "src_type", "tgt_type", "mode", "target")) -> DataFrame:
    """New rows replace old ones of the same key; an old table without tgt_type counts as real."""
    if "tgt_type" not in old.columns:
        old = old.withColumn("tgt_type", F.lit("real"))
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("mark").agg(F.count_if(F.col("y") == 0).alias("normal"), F.count_if(F.col("y") == 1).alias("anomaly"))


def shot_budget(counts: DataFrame, shots: list[int]) -> DataFrame:
    """Support and query class sizes per shot and support policy, and why a shot is not feasible."""
    k = F.explode(F.array(*[F.lit(s) for s in shots])).alias("shot")
    rows = counts.select("normal", "anomaly", k).withColumn("policy", F.explode(F.array(F.lit("per_class"), F.lit("normal_only"))))
    per = F.col("policy") == "per_class"
    sa = F.when(per, F.col("shot")).otherwise(0)
    rows = rows.withColumns({"support_normal": F.col("shot"), "support_anomaly": sa, "query_normal": F.col("normal") - F.col("shot"), "query_anomaly": F.col("anomaly") - sa})
    why = F.when(F.col("query_normal") < 1, "no normal left").when(F.col("query_anomaly") < 1, "no anomaly left")
    return rows.withColumn("reason", F.coalesce(why, F.lit("ok")))


def shot_detail(rows: DataFrame, expected: int) -> DataFrame:
    """Per (context, shot, target): n of ok runs, whether complete, and a status."""
    ok, skipped = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "skipped")
    status = F.when(ok == expected, "ok").when((skipped > 0) & (ok == 0), "skipped").otherwise("incomplete")
    return rows.groupBy("context_id", "shot", "target").agg(ok.alias("n"), F.lit(expected).alias("expected_n"), (ok == expected).alias("complete"), status.alias("status"))


def shot_macro(rows: DataFrame, shots: int, seeds: int, metric: str = "auroc") -> DataFrame:
    """Means over the targets that are ok for every shot and seed; deviation over the seeds' means."""
    ok = rows.where(F.col("status") == "ok")
    cohort = ok.groupBy("context_id", "target").agg(F.countDistinct("shot", "seed").alias("c")).where(F.col("c") == shots * seeds).select("context_id", "target")
    per_seed = ok.join(cohort, ["context_id", "target"]).groupBy("context_id", "shot", "seed").agg(F.avg(metric).alias("m"), F.count("*").alias("targets"))
    return per_seed.groupBy("context_id", "shot").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.max("targets").alias("targets"))
