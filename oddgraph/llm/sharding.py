"""Sharding by a Feistel permutation of global row numbers. Native: SQL functions only.

Rows are numbered 0..N-1 in a fixed order, a keyed Feistel network with cycle walking permutes the
numbers, and the permuted number p gives ``shard = p mod shards`` and ``slot = p div shards``. Both
can be computed for any row number without touching the data, and shard counts differ by one at most
(law ``rows``).

Row numbers: rows are hashed by key into a fixed count of buckets, numbered inside each bucket by
(key, size, checksum), and the bucket's offset is added. Rows that agree in all three columns are
counted before the shuffle and unfolded after it, so a key that holds a third of all rows is one
row in the numbering. Null keys and texts are ordinary values (a null text has size 16 and the
checksum of an empty text); repeated rows get separate numbers; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
ROUNDS = 6


def _round(value: Column, key: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(key)), F.lit(modulus))


def feistel(x: Column, n: int, seed: int) -> Column:
    """A permutation of [0, a*b) with a*b >= n, a and b near sqrt(n); x is a long column.

    Halves l in [0, a) and r in [0, b); each round adds a keyed hash of one half to the other.
    """
    a = int(max(1, n - 1) ** 0.5) + 1
    b = -(-n // a)
    state = F.struct((F.floor(x / F.lit(b))).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        key = i + F.lit(seed * 1000003)
        return F.struct(
            F.when(even, F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], key), F.lit(a)), F.lit(a))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], key), F.lit(b)), F.lit(b))).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), state, one, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """The permutation of [0, n): numbers that fall at or beyond n walk on along their cycle.

    The domain exceeds n by less than sqrt(n) + 1 numbers, so a second step is rare; a walk of more
    than 64 steps raises an error rather than giving a wrong number.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), feistel(x, n, seed), lambda s, _: F.when(s < n, s).otherwise(feistel(s, n, seed))
    )
    first = feistel(x, n, seed)
    return F.when(first < n, first).when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def numbered(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Each row of the key columns once per occurrence, with its global row number ``row_no``."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(keys[0])), F.lit(buckets)).cast("int")
    per_bucket = rows.groupBy(bucket.alias("_b")).count().collect()  # at most `buckets` rows
    total, offset = 0, [0] * buckets
    for row in sorted(per_bucket, key=lambda r: r["_b"]):
        offset[row["_b"]] = total
        total += row["count"]
    offsets = F.array(*[F.lit(x).cast("long") for x in offset])
    del spark
    w = Window.partitionBy("_b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_b", bucket)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)) + F.element_at(offsets, F.col("_b") + 1))
    return placed.select(*keys, F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("_n") - 1)).alias("row_no")), total


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every document under law ``rows``.

    Returns the key, size (UTF-8 bytes of the text plus 16), text_crc32, row_no, position, shard, slot.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed, total = numbered(rows, ["key", "size", "text_crc32"])
    return placed.withColumn("position", permuted(F.col("row_no"), total, seed)).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        "row_no",
        "position",
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
    )


def op10_feistel_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no"
    )
