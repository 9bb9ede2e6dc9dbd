"""The shot sweep: every method and mode over shots, seeds and targets, resumable, with a manifest of contexts.

A context is all that results depend on but shots and seeds: sources, targets, settings, a version of the
method's code and the targets' label counts. Its digest names the rows, so a changed context starts anew
and an added shot does not. Rows are saved after each group of targets, in a folder of their own; a later
row of the same key stands for the earlier ones.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddgraph.operators import metrics as M

#: method(spark, sources, target, shot, seed, hp) -> scores(id, score, y, mark) of the target's query
Method = Callable[..., DataFrame]
KEYS = ["context_id", "shot", "seed", "target"]
ROW = (
    "context_id string, method string, support_policy string, src_type string, tgt_type string, mode string, shot int, seed int, target string, status string, reason string, "
    "support_normal long, support_anomaly long, query_normal long, query_anomaly long, auroc double, auprc double, saved long"
)


@dataclass(frozen=True)
class Sweep:
    methods: dict[str, Method]
    policies: dict[str, str]  # method -> per_class | normal_only
    sources: dict[str, tuple[str, ...]]  # mode -> source names
    targets: tuple[str, ...]
    labels: Callable[[SparkSession, str], DataFrame]  # nodes(y, mark) of a target
    shots: tuple[int, ...] = (1, 3, 5, 10, 20, 50)
    seeds: tuple[int, ...] = tuple(range(11))
    src_type: str = "real"
    tgt_type: str = "real"
    hp: dict = field(default_factory=dict)

    def quick(self) -> Sweep:
        """One seed and the first two targets."""
        return Sweep(self.methods, self.policies, self.sources, self.targets[:2], self.labels, self.shots, self.seeds[:1], self.src_type, self.tgt_type, self.hp)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def contexts(spark: SparkSession, s: Sweep) -> dict[str, dict]:
    """Contexts by their digest, in the order of methods and modes."""
    counts = {t: M.label_counts(s.labels(spark, t)).first().asDict() for t in s.targets}
    out = {}
    for name, method in s.methods.items():
        code = hashlib.sha256(inspect.getsource(method).encode()).hexdigest()
        for mode, sources in s.sources.items():
            held = {"method": name, "mode": mode, "sources": list(sources), "targets": list(s.targets), "hp": s.hp, "types": [s.src_type, s.tgt_type], "policy": s.policies[name], "code": code, "labels": counts}
            out[hashlib.sha256(canonical(held).encode()).hexdigest()[:16]] = held
    return out


def manifest(spark: SparkSession, root: str) -> dict[str, dict]:
    """All contexts that runs under this folder have had. A context whose digest is not its name is passed over."""
    try:
        lines = spark.read.text(f"{root}/contexts/*").collect()
    except AnalysisException:
        return {}
    held = [json.loads(r["value"]) for r in lines]
    return {hashlib.sha256(canonical(h).encode()).hexdigest()[:16]: h for h in held}


def rows(spark: SparkSession, root: str) -> DataFrame:
    """The last saved row of each key."""
    try:
        saved = spark.read.schema(ROW).parquet(f"{root}/rows/*")
    except AnalysisException:
        return spark.createDataFrame([], ROW)
    last = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("saved")))
    return saved.withColumn("_r", last).where("_r = 1").drop("_r")


def run(spark: SparkSession, s: Sweep, root: str, progress: Callable | None = None) -> DataFrame:
    """Rows of the whole sweep. What is saved with status ok is not run again; shots a target's classes do not
    allow are skipped with a reason; a failure is saved and the group goes on, then it is raised."""
    root, plans, known = root.rstrip("/"), contexts(spark, s), manifest(spark, root.rstrip("/"))
    for digest, held in plans.items():
        if digest not in known:
            spark.createDataFrame([(canonical(held),)], "value string").coalesce(1).write.text(f"{root}/contexts/{digest}-{uuid.uuid4().hex}")
    before = rows(spark, root).select(*KEYS, "status", "saved").collect()
    done = {tuple(r[k] for k in KEYS) for r in before if r["status"] == "ok"}
    turn = max((r["saved"] for r in before), default=0)
    for digest, held in plans.items():
        counts = spark.createDataFrame([(t, held["labels"][t]["normal"], held["labels"][t]["anomaly"]) for t in s.targets], "target string, normal long, anomaly long")
        budgets = {(b["target"], b["shot"]): b for t in s.targets for b in M.shot_budget(counts.where(F.col("target") == t), list(s.shots)).where(F.col("policy") == held["policy"]).withColumn("target", F.lit(t)).collect()}
        for shot in s.shots:
            for seed in s.seeds:
                fresh, errors = [], []
                for target in s.targets:
                    if (digest, shot, seed, target) in done:
                        continue
                    b = budgets[target, shot]
                    sizes = tuple(b[k] for k in ("support_normal", "support_anomaly", "query_normal", "query_anomaly"))
                    status, reason, auroc, auprc = ("skipped", b["reason"], None, None) if b["reason"] != "ok" else ("ok", "", None, None)
                    if status == "ok":
                        try:
                            one = M.evaluate(s.methods[held["method"]](spark, tuple(held["sources"]), target, shot, seed, s.hp)).first()
                            auroc, auprc = one["auroc"], one["auprc"]
                        except Exception as error:  # recorded with its row, raised after the group
                            status, reason = "failed", (str(error) or type(error).__name__).splitlines()[0][:200]
                            errors.append(error)
                    turn += 1
                    fresh.append((digest, held["method"], held["policy"], s.src_type, s.tgt_type, held["mode"], shot, seed, target, status, reason, *sizes, auroc, auprc, turn))
                if fresh:
                    spark.createDataFrame(fresh, ROW).coalesce(1).write.parquet(f"{root}/rows/{turn:012d}-{uuid.uuid4().hex}")
                if progress:
                    progress(held["method"], held["mode"], shot, seed, len(fresh))
                if errors:
                    raise errors[0]
    mine = rows(spark, root).where(F.col("context_id").isin(list(plans)) & F.col("shot").isin(list(s.shots)) & F.col("seed").isin(list(s.seeds)))
    return mine.drop("saved")


def reports(sweep_rows: DataFrame, s: Sweep) -> tuple[DataFrame, DataFrame]:
    """Detail by context, shot and target, and means over the targets that are ok for every shot and seed."""
    return M.shot_detail(sweep_rows, len(s.seeds)), M.shot_macro(sweep_rows, len(s.shots), len(s.seeds))
