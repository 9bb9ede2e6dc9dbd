"""Column expressions over ARRAY<DOUBLE> vectors and keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l1(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column | str) -> Column:
    """The vector over its length; a zero vector stays."""
    n = F.array_repeat(norm(a), F.size(col(a)))  # once a vector; within a lambda it would be made for each entry
    return F.zip_with(col(a), n, lambda x, n: F.when(n > 0, x / n).otherwise(x))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def scaled(a: Column | str, s: Column | float) -> Column:
    return F.transform(col(a), lambda x: x * s)


def ordered_key(seed: int, *keys: Column | str) -> Column:
    """A stateless shuffle key: md5 of the seed and the ids as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the shuffle key."""
    return F.conv(F.substring(ordered_key(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def sum_vectors(f: Column | str, width: int, weight: Column | None = None) -> Column:
    """One sum per dimension, which stays in generated code and is combined before the shuffle."""
    f = col(f)
    return F.array(*[F.sum(f[i] if weight is None else weight * f[i]) for i in range(width)])


def avg_vectors(f: Column | str, width: int) -> Column:
    return F.array(*[F.avg(col(f)[i]) for i in range(width)])


def zeros(width: int) -> Column:
    return F.array(*[F.lit(0.0)] * width)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/.shared").rstrip("/")
