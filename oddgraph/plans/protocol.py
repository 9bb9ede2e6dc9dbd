"""The protocol driver: methods x targets x seeds x modes, with upsert results and isolation of errors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddgraph.operators import metrics as M

#: method(spark, sources, target, seed, hp) -> scores(id, score, y, mark)
Method = Callable[..., DataFrame]
ROW = "method string, src_type string, tgt_type string, mode string, target string, seed int, status string, reason string, auroc double, auprc double"


@dataclass(frozen=True)
class Plan:
    methods: dict[str, Method]
    sources: dict[str, tuple[str, ...]]  # mode -> source names
    targets: tuple[str, ...]
    seeds: tuple[int, ...] = tuple(range(11))
    src_type: str = "real"
    tgt_type: str = "real"
    hp: dict = field(default_factory=dict)
    source_free: frozenset[str] = frozenset()

    def quick(self) -> Plan:
        """One seed and the first two targets."""
        return Plan(self.methods, self.sources, self.targets[:2], self.seeds[:1], self.src_type, self.tgt_type, self.hp, self.source_free)

    def context_id(self) -> str:
        """Fingerprint of everything but the shots and seeds, so that adding some keeps it."""
        held = {"methods": sorted(self.methods), "sources": {k: list(v) for k, v in self.sources.items()}, "targets": list(self.targets), "hp": self.hp, "types": [self.src_type, self.tgt_type]}
        return hashlib.sha256(json.dumps(held, sort_keys=True, default=str).encode()).hexdigest()[:16]


def run(spark: SparkSession, plan: Plan, done: DataFrame | None = None, evaluator: Callable | None = None, progress: Callable | None = None) -> DataFrame:
    """Seed rows of all combinations; those in ``done`` with status ok are not run again.

    A target whose method raises is recorded as failed and the rest goes on. Methods without sources
    are scored once and reused for every mode.
    """
    keys = ["method", "mode", "target", "seed"]
    have = {tuple(r) for r in done.where("status = 'ok'").select(*keys).collect()} if done is not None else set()
    rows, memo = [], {}
    for name, method in plan.methods.items():
        for mode, sources in plan.sources.items():
            for target in plan.targets:
                for seed in plan.seeds:
                    if (name, mode, target, seed) in have:
                        continue
                    key = (name, target, seed) if name in plan.source_free else (name, mode, target, seed)
                    if key not in memo:
                        try:
                            scores = method(spark, sources, target, seed, plan.hp)
                            one = (evaluator or (lambda _n, _s, x: M.evaluate(x)))(target, seed, scores).first()
                            memo[key] = ("ok", None, one["auroc"], one["auprc"])
                        except Exception as error:  # one target's failure does not end the run; it is recorded
                            memo[key] = ("failed", str(error).splitlines()[0][:200], None, None)
                    rows.append((name, plan.src_type, plan.tgt_type, mode, target, seed, *memo[key]))
                if progress:
                    progress(name, mode, target)
    new = spark.createDataFrame(rows, ROW)
    return new if done is None else M.upsert(done, new, ("method", "src_type", "tgt_type", "mode", "target", "seed"))


def detail(rows: DataFrame) -> DataFrame:
    return M.seed_summary(rows.where("status = 'ok'"), ["method", "src_type", "tgt_type", "mode", "target"], ["auroc", "auprc"])


def write_csv(df: DataFrame, path: str) -> None:
    """A header CSV by the committer, which publishes whole results only; nothing for no rows."""
    if not df.isEmpty():
        df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def preflight(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Tables that are missing or empty; reads through Spark's file system and writes nothing."""
    missing = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path) or fs.getContentSummary(path).getLength() == 0:
            missing.append(p)
    return missing


def result_name(base: str, mode: str) -> str:
    """File name per metric mode."""
    stem, dot, end = base.rpartition(".")
    return base if mode == "standard" else f"{stem}_{mode.replace('-', '_')}{dot}{end}"


def marked_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    return nodes.select("id", "y", "mark").join(scores.select("id", "score"), "id", "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
