"""Files to graphs through the catalog, and the feature store's checks."""

import shutil
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddgraph.sources import files, store
from oddgraph.sources import graphs as src


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_are_read_in_ranges(spark, tmp_path, save):
    rng = np.random.default_rng(0)
    x, y, e = rng.standard_normal((50, 3)).astype(np.float32), rng.integers(0, 4, 50), rng.integers(0, 50, (120, 2)).astype(np.int32)
    flags = np.zeros(50, bool)
    flags[[3, 9]] = True
    save(tmp_path / "g.npz", x=x, y=y, edge_index=e, train_mask=np.arange(5), valid_mask=flags, test_mask=np.array([40, 3]))
    nodes, edges = files.archive_graph(spark, str(tmp_path / "g.npz"), rows=7)
    assert len(files.ArchiveReader(str(tmp_path / "g.npz"), "nodes", 7).partitions()) == 8
    rows = sorted(nodes.collect())
    assert np.allclose([r["f"] for r in rows], x) and [r["y"] for r in rows] == (y == 1).astype(int).tolist()
    assert [r["id"] for r in rows if r["mark"]] == [0, 1, 2, 3, 4, 9, 40]
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == sorted(map(tuple, e.tolist()))
    save(tmp_path / "all.npz", x=x[:2], y=y[:2], edge_index=e[:0])
    nodes, edges = files.archive_graph(spark, f"file://{tmp_path}/all.npz")
    assert nodes.where("mark").count() == 2 and edges.count() == 0


def test_catalog(spark, tmp_path):
    real, fake = tmp_path / "real", tmp_path / "fake"
    (real / "coins").mkdir(parents=True), fake.mkdir()
    (real / "coins" / "classes.csv").write_text("id,class\n30,unknown\n10,1\n20,2\n")
    (real / "coins" / "features.csv").write_text("10,0.5,1\n20,1.5,2\n30,2.5,3\n")
    (real / "coins" / "edgelist.csv").write_text("a,b\n10,30\n30,20\n")
    np.savez(fake / "coins.npz", x=np.eye(2), y=np.zeros(2), edge_index=np.zeros((0, 2), int))
    np.savez(fake / "other.npz", x=np.eye(2), y=np.array([0, 1]), edge_index=np.array([[0, 1]]))
    catalog = files.GraphCatalog(spark, [str(real), str(fake)])
    nodes, edges = catalog.load("coins")
    assert sorted(map(tuple, nodes.select("id", "f", "y", "mark").collect())) == [(0, [0.5, 1.0], 1, True), (1, [1.5, 2.0], 0, True), (2, [2.5, 3.0], 0, False)]
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [(0, 2), (2, 1)]
    assert catalog.find("other")[0] == "archive" and catalog.find("coins")[0] == "csv"
    catalog.convert("coins", str(real))
    assert catalog.find("coins")[0] == "tables"
    labels = catalog.labels("coins")
    assert labels.columns == ["id", "y", "mark"] and "ReadSchema: struct<id:bigint,y:int,mark:boolean>" in labels._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError, match="missing"):
        catalog.load("missing")


def test_row_numbers_of_strings(spark):
    keys = [f"k{i * 7919 % 1000:04d}" for i in range(1000)]
    got = {r["k"]: r["id"] for r in src.row_numbers(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def table(spark, n=20, width=3):
    return spark.createDataFrame([(i, [float(i + j) for j in range(width)]) for i in range(n)], "id long, f array<double>")


def test_store_makes_an_entry_once_and_follows_its_source(spark, tmp_path):
    held, made = store.FeatureStore(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return table(spark).withColumn("f", F.transform("f", lambda x: x * 2))

    key = held.key(table(spark), rank=3)
    assert key == held.key(table(spark).repartition(7), rank=3) and key != held.key(table(spark), rank=4) != held.key(table(spark, 21), rank=4)
    assert key != held.key(table(spark).withColumn("f", F.col("f").cast("array<float>")), rank=3)
    first, again = (sorted(held.load_or_make(key, make, 3).collect()) for _ in range(2))
    assert first == again and len(made) == 1 and first[1]["f"] == [2.0, 4.0, 6.0]


@pytest.mark.parametrize("harm", ["cut file", "lost file", "other rows", "wrong width", "no manifest", "bad manifest"])
def test_store_passes_over_what_does_not_agree(spark, tmp_path, harm):
    held = store.FeatureStore(spark, str(tmp_path))
    key = held.key(table(spark))
    version = Path(held.publish(key, table(spark, width=2 if harm == "wrong width" else 3).coalesce(2)))
    parts, manifest = sorted(version.glob("part-*.parquet")), next((tmp_path / key / "manifests").rglob("part-*"))
    for crc in tmp_path.rglob(".*.crc"):
        crc.unlink()
    if harm == "cut file":
        parts[0].write_bytes(parts[0].read_bytes()[:50])
    elif harm == "lost file":
        parts[0].unlink()
    elif harm == "other rows":
        table(spark, 20).withColumn("f", F.transform("f", lambda x: x + 1)).write.mode("overwrite").parquet(str(version))
    elif harm == "no manifest":
        shutil.rmtree(tmp_path / key / "manifests")
    elif harm == "bad manifest":
        manifest.write_text("{half a man")
    assert held.load(key, 3) is None
    assert held.load_or_make(key, lambda: table(spark), 3).count() == 20 and held.load(key, 3) is not None


def test_two_writers_publish_whole_versions(spark, tmp_path):
    held = store.FeatureStore(spark, str(tmp_path))
    key = held.key(table(spark))
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda _: sorted(held.load_or_make(key, lambda: table(spark), 3).collect()), range(2)))
    assert found[0] == found[1] == sorted(table(spark).collect())
    assert 1 <= len(held.manifests(key)) <= 2 and all(held.valid(key, m, 3) is not None for m in held.manifests(key))
