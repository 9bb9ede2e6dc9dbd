"""Stored features, addressed by the content they were made from.

An entry's folder is named by a digest of its source rows and of how they were processed. A writer puts
its rows into a folder of its own and then, when these are whole, a manifest that tells rows, width and
digest, so two writers of one entry don't disturb each other and a reader sees only whole ones. A reader
checks a manifest against the rows; what does not agree is passed over, and made anew if nothing is left.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNREADABLE = (PySparkException, Py4JJavaError)


def digest(rows: DataFrame, *columns: str) -> str:
    """A digest of rows that does not depend on their order: their number and the sums of both halves of an md5 of each."""
    key = F.md5(F.to_json(F.struct(*(columns or rows.columns))))
    half = lambda a: F.sum(F.conv(F.substring(key, a, 15), 16, 10).cast("decimal(38,0)"))
    got = rows.agg(F.count("*").alias("n"), half(1).alias("a"), half(17).alias("b")).first()
    return hashlib.sha256(f"{got['n']}:{got['a']}:{got['b']}".encode()).hexdigest()


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, source: DataFrame, **settings) -> str:
        """The entry's name: content and types of the source, and settings."""
        held = {"content": digest(source), "types": source.schema.simpleString(), "settings": settings}
        return hashlib.sha256(json.dumps(held, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def _describe(self, rows: DataFrame) -> dict:
        sizes = rows.agg(F.min(F.size("f")).alias("least"), F.max(F.size("f")).alias("most")).first()
        return {"types": rows.schema.simpleString(), "digest": digest(rows), "least": sizes["least"], "most": sizes["most"]}

    def publish(self, key: str, rows: DataFrame) -> str:
        """Write rows(id, f) as a version of an entry; its folder."""
        version = uuid.uuid4().hex
        path = f"{self.root}/{key}/{version}"
        rows.write.parquet(path)
        manifest = {"version": version, **self._describe(self.spark.read.schema(rows.schema).parquet(path))}
        # A version counts when its manifest is there, which is the last thing written.
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.root}/{key}/manifests/{version}")
        return path

    def manifests(self, key: str) -> list[dict]:
        """Manifests of an entry's whole versions, in the order of their names; what is no JSON counts as none."""
        try:
            lines = self.spark.read.text(f"{self.root}/{key}/manifests/*").collect()
        except _UNREADABLE:
            return []
        found = []
        for r in lines:
            try:
                found.append(json.loads(r["value"]))
            except ValueError:
                continue
        return sorted((m for m in found if isinstance(m, dict) and "version" in m), key=lambda m: m["version"])

    def valid(self, key: str, manifest: dict, width: int | None = None) -> DataFrame | None:
        """The rows of a version, if they can be read whole and agree with the manifest, and are ``width`` wide."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/{key}/{manifest['version']}")
            held = self._describe(rows)
        except _UNREADABLE:
            return None
        agrees = all(held[k] == manifest.get(k) for k in held)
        return rows if agrees and (width is None or held["least"] == held["most"] == width) else None

    def load(self, key: str, width: int | None = None) -> DataFrame | None:
        for manifest in self.manifests(key):
            rows = self.valid(key, manifest, width)
            if rows is not None:
                return rows
        return None

    def load_or_make(self, key: str, make: Callable[[], DataFrame], width: int | None = None) -> DataFrame:
        """A valid version, or a new one."""
        rows = self.load(key, width)
        if rows is None:
            rows = self.spark.read.parquet(self.publish(key, make()))
        return rows
