"""What the training-data operators share: the shared folder, word hashing, keyed helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, local mode) the warehouse folder of the session serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/.shared").rstrip("/")


def stored(df: DataFrame, hint: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut of the lineage
    that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{hint}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``stored`` returned and that no later plan reads."""
    path = df._stored_path
    _MADE.remove(path)
    delete(df.sparkSession, [path])


def made_since(mark: int) -> list[str]:
    """Folders that ``stored`` has written since there were ``mark`` of them."""
    return _MADE[mark:]


def mark() -> int:
    return len(_MADE)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of ``stored`` whose readers have been written elsewhere."""
    conf = spark._jsc.hadoopConfiguration()
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def binary_list(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text of a batch; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, limit + (ends[a - 1] if a else 0), "right")))
            yield batch.slice(a, b - a)
            a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits, vectorised."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Bytes of one text that are split into words at a time, and words that are hashed at a time.
_PIECE, _WORDS = 1 << 24, 1 << 18
_KEY = "words of a text:"
_SPACE = re.compile(rb"[ \t-\r]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end before white space."""
    a = 0
    while len(text) - a > _PIECE:
        gap = _SPACE.search(text, a + _PIECE)
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b
    yield text[a:]


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of signs that are no ASCII white space) of a batch of texts, and where
    each text's words begin: those of text i are hashes[at[i]:at[i + 1]]. Null texts have no words.

    A word's hash is keyed SipHash of its bytes, for which no structure of a word makes collisions.
    """
    words, hashed, at = [], [], [0]

    def hash_words():
        hashed.append(pd.util.hash_array(np.array(words, dtype=object), hash_key=_KEY, categorize=False))
        words.clear()

    for text in binary_list(column):
        n = 0
        for piece in _pieces(text):
            found = (piece.lower() if lower else piece).split()
            words += found
            n += len(found)
            if len(words) >= _WORDS:
                hash_words()
        at.append(at[-1] + n)
    if words:
        hash_words()
    return np.concatenate(hashed) if hashed else np.empty(0, np.uint64), np.array(at, np.int64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by doubling: O(log k) vector operations."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, width, rest = None, 0, words, 1, k
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += width
        rest >>= 1
        if rest:
            power = mix(power[: len(power) - width] * np.uint64(0xD6E8FEB86659FD93) + power[width:])
            width *= 2
    return mix(out + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
