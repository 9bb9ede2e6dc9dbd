"""The shot sweep: budgets, resume, contexts and reports."""

import json

import pytest
from pyspark.sql import functions as F

from oddgraph.plans import sweep

CALLS, BROKEN = [], set()
SIZES = {"wide": (30, 12), "narrow": (30, 2), "none": (30, 0)}


def labels(spark, target):
    normal, anomaly = SIZES[target]
    return spark.range(normal + anomaly).select("id", (F.col("id") >= normal).cast("int").alias("y"), F.lit(True).alias("mark"))


def method(spark, sources, target, shot, seed, hp):
    CALLS.append((tuple(sources), target, shot, seed))
    if target in BROKEN:
        raise RuntimeError("no such graph")
    return labels(spark, target).withColumn("score", F.col("id") * (1.0 if len(sources) > 1 else -1.0))


def plan(**changes):
    held = {"methods": {"m": method}, "policies": {"m": "per_class"}, "sources": {"single": ("a",), "multi": ("a", "b")}, "targets": ("wide", "narrow", "none"), "labels": labels, "shots": (1, 5), "seeds": (0, 1)}
    return sweep.Sweep(**(held | changes))


def test_sweep(spark, tmp_path):
    CALLS.clear(), BROKEN.clear()
    root = str(tmp_path)
    got = {(r["mode"], r["shot"], r["seed"], r["target"]): r for r in sweep.run(spark, plan(), root).collect()}
    assert len(got) == 2 * 2 * 2 * 3 and len(CALLS) == 2 * 2 * (2 + 1)
    r = got["multi", 1, 0, "narrow"]
    assert (r["status"], r["auroc"], r["support_anomaly"], r["query_anomaly"]) == ("ok", 1.0, 1, 1)
    assert got["single", 5, 1, "wide"]["auroc"] == 0.0
    assert got["single", 5, 1, "narrow"]["status"] == "skipped" and got["multi", 1, 0, "none"]["reason"] == "no anomaly left"
    # Nothing is run twice; a new shot keeps its context, other settings start a new one.
    sweep.run(spark, plan(), root)
    assert len(CALLS) == 12
    more = sweep.run(spark, plan(shots=(1, 5, 10)), root)
    assert len(CALLS) == 12 + 2 * 2 and more.select("context_id").distinct().count() == 2 and more.count() == 36
    assert len(sweep.manifest(spark, root)) == 2
    sweep.run(spark, plan(hp={"depth": 3}, seeds=(0,)), root)
    assert len(CALLS) == 16 + 2 * 3 and len(sweep.manifest(spark, root)) == 4
    detail, macro = sweep.reports(sweep.run(spark, plan(), root), plan())
    status = {(r["shot"], r["target"]): r["status"] for r in detail.collect()}
    assert status == {(1, "wide"): "ok", (5, "wide"): "ok", (1, "narrow"): "ok", (5, "narrow"): "skipped", (1, "none"): "skipped", (5, "none"): "skipped"}
    assert {r["targets"] for r in macro.collect()} == {1} and sorted(r["mean"] for r in macro.collect()) == [0.0, 0.0, 1.0, 1.0]


def test_failures_are_kept_and_run_again(spark, tmp_path):
    CALLS.clear(), BROKEN.add("wide")
    root = str(tmp_path)
    with pytest.raises(RuntimeError, match="no such graph"):
        sweep.run(spark, plan(seeds=(0,)), root)
    saved = {(r["shot"], r["target"]): r["status"] for r in sweep.rows(spark, root).collect()}
    assert saved == {(1, "wide"): "failed", (1, "narrow"): "ok", (1, "none"): "skipped"}
    BROKEN.clear()
    done = sweep.run(spark, plan(seeds=(0,)), root)
    assert done.where("status = 'failed'").isEmpty() and done.count() == 12
    assert [c[1:] for c in CALLS].count(("narrow", 1, 0)) == 2  # once a mode
    only = plan().quick()
    assert only.seeds == (0,) and only.targets == ("wide", "narrow")


def test_contexts_are_named_by_content(spark, tmp_path):
    held = sweep.contexts(spark, plan())
    assert held == sweep.contexts(spark, plan(shots=(7,), seeds=(3,))) and not set(held) & set(sweep.contexts(spark, plan(targets=("wide",))))
    assert {h["labels"]["narrow"]["anomaly"] for h in held.values()} == {2}
    (tmp_path / "contexts" / "x").mkdir(parents=True)
    (tmp_path / "contexts" / "x" / "part").write_text(json.dumps({"method": "other"}))
    assert not set(sweep.manifest(spark, str(tmp_path))) & set(held)
