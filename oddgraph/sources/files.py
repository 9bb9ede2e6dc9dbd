"""Graphs from files: archives of arrays, three CSV files, and tables; found by name in a list of folders."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from oddgraph.sources.graphs import csv_graph

Graph = tuple[DataFrame, DataFrame]
#: Rows of an array that one task reads.
ROWS = 1 << 18
# Names of an archive's arrays of split members.
SPLITS = ("train_mask", "valid_mask", "test_mask")


# ---- archives of arrays


def _header(archive: zipfile.ZipFile, name: str) -> tuple[int, tuple[int, ...], np.dtype]:
    """Where the data of an array begin in its member, its shape and type."""
    with archive.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(f)
        if fortran and len(shape) > 1:
            raise ValueError(f"{name} is stored by columns")
        return f.tell(), shape, kind


def _rows(path: str, name: str, a: int, b: int) -> np.ndarray:
    """Rows a to b of an array: the member is read from there on, nothing else is kept."""
    with zipfile.ZipFile(path) as archive:
        start, shape, kind = _header(archive, name)
        width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
        with archive.open(f"{name}.npy") as f:
            f.seek(start + a * width)
            return np.frombuffer(f.read((b - a) * width), kind).reshape(-1, *shape[1:])


@dataclass
class _Range(InputPartition):
    name: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int):
        self.path, self.table, self.rows = path, table, rows

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as archive:
            names = {n.removesuffix(".npy") for n in archive.namelist()}
            wanted = {"nodes": ["x"], "edges": ["edge_index"], "marks": [s for s in SPLITS if s in names]}[self.table]
            found = [(n, _header(archive, n)[1][0]) for n in wanted]
        return [_Range(n, a, min(a + self.rows, size)) for n, size in found for a in range(0, size, self.rows)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without rows
            return
        a, b, x = partition.start, partition.stop, _rows(self.path, partition.name, partition.start, partition.stop)
        if self.table == "nodes":
            y = _rows(self.path, "y", a, b).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(list(x.astype(float)), pa.list_(pa.float64())), pa.array((y == 1).astype(np.int32))], ["id", "f", "y"])
        elif self.table == "edges":
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1].astype(np.int64)), pa.array(np.ones(len(x)))], ["src", "dst", "w"])
        else:
            ids = a + np.flatnonzero(x) if x.dtype == bool else x.reshape(-1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])


class Archive(DataSource):
    """``spark.read.format("graph_npz").option("table", nodes | edges | marks).load(path)``: ranges of rows are
    read by tasks of their own. The path must be one that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "graph_npz"

    def schema(self) -> str:
        return {"nodes": "id long, f array<double>, y int", "edges": "src long, dst long, w double", "marks": "id long"}[self.options.get("table", "nodes")]

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"].removeprefix("file://").removeprefix("file:"), self.options.get("table", "nodes"), int(self.options.get("rows", ROWS)))


def archive_graph(spark: SparkSession, path: str, rows: int = ROWS) -> Graph:
    """nodes(id, f, y, mark) and edges of an archive with x, y, edge_index and split arrays, of indices or of
    flags, whose union marks the nodes; without any, all nodes are marked."""
    spark.dataSource.register(Archive)
    read = lambda table: spark.read.format("graph_npz").option("table", table).option("rows", rows).load(path)
    nodes, marks = read("nodes"), read("marks").distinct()
    if marks.isEmpty():
        return nodes.withColumn("mark", F.lit(True)), read("edges")
    marked = nodes.join(marks.withColumn("mark", F.lit(True)), "id", "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
    return marked, read("edges")


# ---- three CSV files


def csv_files(spark: SparkSession, classes: str, features: str, pairs: str) -> Graph:
    """A graph from a file of external ids and classes and one of edges, both with a header, and one of ids and
    feature columns without. Class "1" is the anomaly, "unknown" is not marked; ids are numbered in their order."""
    label = spark.read.csv(classes, header=True)
    label = label.select(F.col(label.columns[0]).cast("long").alias("ext"), F.col(label.columns[1]).alias("class"))
    x = spark.read.csv(features, header=False)
    x = x.select(F.col(x.columns[0]).cast("long").alias("ext"), F.array(*[F.col(c).cast("double") for c in x.columns[1:]]).alias("f"))
    e = spark.read.csv(pairs, header=True)
    return csv_graph(label, x, e.select(*[F.col(c).cast("long").alias(n) for c, n in zip(e.columns, "ab")]))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, through Spark's own file listing; no content is read."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").isEmpty()
    except AnalysisException:
        return False


class GraphCatalog:
    """Graphs by name. A name is looked for in each folder in turn (real ones before injected ones), first as
    tables, then as an archive, then as three CSV files."""

    def __init__(self, spark: SparkSession, folders: list[str]):
        self.spark, self.folders = spark, [f.rstrip("/") for f in folders]

    def _forms(self, base: str) -> list[tuple[str, str, Callable[[], Graph]]]:
        csv = [f"{base}/{part}.csv" for part in ("classes", "features", "edgelist")]
        tables = [f"{base}/{part}.parquet" for part in ("nodes", "edges")]
        return [
            ("tables", tables[0], lambda: tuple(self.spark.read.parquet(t) for t in tables)),
            ("archive", f"{base}.npz", lambda: archive_graph(self.spark, f"{base}.npz")),
            ("csv", csv[0], lambda: csv_files(self.spark, *csv)),
        ]

    def find(self, name: str) -> tuple[str, str, Callable[[], Graph]]:
        """(form, path, loader) of the first that is there."""
        for folder in self.folders:
            for form in self._forms(f"{folder}/{name}"):
                if exists(self.spark, form[1]):
                    return form
        raise FileNotFoundError(f"{name} is in none of {self.folders}")

    def load(self, name: str) -> Graph:
        """nodes(id, f, y, mark) and edges(src, dst, w): the whole graph, never a sample."""
        return self.find(name)[2]()

    def labels(self, name: str) -> DataFrame:
        """(id, y, mark) alone; of tables no other column is read."""
        return self.load(name)[0].select("id", "y", "mark")

    def convert(self, name: str, folder: str) -> None:
        """The graph as tables in a folder of the catalog."""
        nodes, edges = self.load(name)
        edges.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/edges.parquet")
        nodes.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/nodes.parquet")
