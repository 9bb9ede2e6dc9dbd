"""Token ids as wavelet matrices, one per shard.

Documents are dealt by ranges of doc_id and sorted; each task encodes its texts and cuts shards at
document boundaries after ``SHARD_TOKENS`` ids. A shard is one self-contained compressed image:
the document table and the bit-planes of a wavelet matrix over the shard's ids. Access, counting and
occurrence lookup work on the image alone. Images are rows of Parquet files in the shared folder, so
any store Spark can write holds them and lost tasks are redone by its committer.

Defined results: a null text is empty (only the end id); null ids come first; rows with equal ids are
ordered by text; an empty table writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddgraph.llm.common import stored
from oddgraph.llm.encode import encoder

SHARD_TOKENS = 1 << 20
END_ID = 2
_MAGIC = b"WMX1"
_BLOCK = 64  # bytes of a rank block: 512 bits


class WaveletMatrix:
    """Rank and select over a sequence of unsigned integers.

    planes[k] holds bit (levels-1-k) of the values in the order of level k, packed big end first;
    zeros[k] counts its zero bits. ranks[k][j] counts the ones before byte j * 64.
    """

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros, self.levels = n, planes, zeros, len(planes)
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        top = int(values.max()) if len(values) else 0
        levels = max(1, top.bit_length())
        values = values.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(levels - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            planes.append(np.packbits(ones))
            low = values[~ones]
            zeros.append(len(low))
            values = np.concatenate([low, values[ones]])
        return cls(len(values), planes, zeros)

    def decode(self) -> np.ndarray:
        """All values in order: the partitions of the levels undone from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n).view(bool)
            above = np.empty_like(values)
            above[~ones] = values[: self.zeros[k]]
            above[ones] = values[self.zeros[k] :] | values.dtype.type(1 << (self.levels - 1 - k))
            values = above
        return values.astype(np.uint32)

    @property
    def ranks(self) -> list[np.ndarray]:
        if self._ranks is None:
            self._ranks = []
            for plane in self.planes:
                padded = np.zeros(-(-len(plane) // _BLOCK) * _BLOCK, np.uint8)
                padded[: len(plane)] = plane
                ones = np.bitwise_count(padded).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        return self._ranks

    def _ones(self, k: int, i: int) -> int:
        """Ones of level k before place i."""
        byte, block = i >> 3, (i >> 3) // _BLOCK
        out = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][block * _BLOCK : byte]).sum())
        return out + (int(self.planes[k][byte]) >> (8 - (i & 7))).bit_count() if i & 7 else out

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit = int(self.planes[k][i >> 3]) >> (7 - (i & 7)) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Places at the last level of the value's occurrences before place i."""
        if value >> self.levels:
            return 0, 0
        lo, hi = 0, i
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of the value before place i."""
        lo, hi = self._range(value, min(max(i, 0), self.n))
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _place(self, k: int, bit: int, rank: int) -> int:
        """The place at level k of the rank-th (from 0) zero or one."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            before = self._ones(k, mid)
            if (before if bit else mid - before) <= rank:
                lo = mid
            else:
                hi = mid
        return lo

    def select(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of the value, -1 if there are fewer."""
        lo, hi = self._range(value, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i = lo + j
        for k in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - k) & 1
            i = self._place(k, bit, i - self.zeros[k] if bit else i)
        return i


def pack_shard(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
    """The file image of a shard: magic, sizes, then the compressed document table and planes."""
    wm = WaveletMatrix.build(ids)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    null = np.array([d is None for d in doc_ids], np.uint8)
    table = squeeze(null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(ends, "<i8").tobytes())
    parts = [squeeze(p.tobytes()) for p in wm.planes]
    head = struct.pack("<4sQQI", _MAGIC, len(doc_ids), wm.n, wm.levels) + np.array([len(table), *wm.zeros, *map(len, parts)], "<i8").tobytes()
    return b"".join([head, table, *parts])


def open_shard(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, the end of each document's ids, and the wavelet matrix."""
    magic, docs, n, levels = struct.unpack_from("<4sQQI", image)
    if magic != _MAGIC:
        raise ValueError("not a wavelet shard")
    at = struct.calcsize("<4sQQI")
    sizes = np.frombuffer(image, "<i8", 1 + 2 * levels, at).tolist()
    at += 8 * (1 + 2 * levels)
    spread = zstandard.ZstdDecompressor().decompress
    table = spread(image[at : at + sizes[0]])
    at += sizes[0]
    null, ids, ends = np.frombuffer(table, np.uint8, docs), np.frombuffer(table, "<i8", docs, docs), np.frombuffer(table, "<i8", docs, 9 * docs)
    planes = []
    for size in sizes[1 + levels :]:
        planes.append(np.frombuffer(spread(image[at : at + size]), np.uint8))
        at += size
    return [None if z else i for z, i in zip(null.tolist(), ids.tolist())], ends, WaveletMatrix(n, planes, sizes[1 : 1 + levels])


def write_shards(docs: DataFrame, path: str, kind: str = "word", end_id: int = END_ID, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode and write all documents; returns the shards: part, seq, n_docs, n_tokens, image."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def build(batches):
        encode, end, part, seq = encoder(path, kind), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        keys, pieces, ends, n = [], [], [], 0

        def shard():
            image = pack_shard(keys, ends, np.frombuffer(b"".join(pieces), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([n], pa.int64()), pa.array([image], pa.binary())],
                ["part", "seq", "n_docs", "n_tokens", "image"],
            )

        for batch in batches:
            for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(t) + end
                keys.append(k)
                pieces.append(ids)
                n += len(ids) // 4
                ends.append(n)
                if n >= shard_tokens:
                    yield shard()
                    seq += 1
                    keys, pieces, ends, n = [], [], [], 0
        if keys:
            yield shard()

    ranged = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return stored(ranged.mapInArrow(build, "part int, seq int, n_docs long, n_tokens long, image binary"), "wavelet", compression="none")


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode the files: doc_id, start (ids before it in all shards), n_tokens, ids, part, seq."""

    def spread(batches):
        for batch in batches:
            for part, seq, image in zip(*(batch[c].to_pylist() for c in ("part", "seq", "image"))):
                keys, ends, wm = open_shard(image)
                raw, starts = wm.decode().astype("<u4").tobytes(), np.concatenate([[0], ends[:-1]])
                ids = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), pa.array([seq] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32", "ids"],
                )

    rows = shards.select("part", "seq", "image").mapInArrow(spread, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")
    # Prefix sums in two levels: within a part, and over the parts, whose count is that of the writing tasks.
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_a"))
    offsets = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("_b")).join(parts, "part")
    placed = rows.join(offsets, ["part", "seq"])
    return placed.select("doc_id", (F.col("_a") + F.col("_b") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids", "part", "seq")


def op1_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(shards).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "seq")
