"""Substring dedup by seed and extend.

Seeds: a document's words are hashed, runs of ``SEED`` words get a rolling hash, and winnowing keeps
the smallest of each span, so that every window of ``WINDOW`` words owns exactly one anchor, a function
of its words alone. Documents are joined on anchors: an anchor in one document only is done with.
Extension: for shared anchors, the windows around them, to both sides, are matched by the hash of
their whole word sequence next to their anchor, and the smallest document of each is kept. Windows
that a smaller document also holds are merged into maximal repeats, whose words are removed.

The anchor stage and the window stage are partial aggregates followed by equi-joins: the cost is
linear in the shared windows, no pairs of documents are made, and hot passages are combined before
the shuffle.

Defined results: words are runs of signs other than ASCII white space; null texts have none; null ids
neither remove nor lose words; rows with equal ids don't remove each other's words; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.llm.common import binary_list, discard, grams, mix, signed, stored, text_blocks, word_hashes

WINDOW, SEED = 50, 25


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    n, done = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while done * 2 <= width:
        x, done = np.minimum(x[:-done], x[done:]), done * 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def anchors(column: pa.Array, window: int, seed: int) -> list[np.ndarray]:
    """The anchor of each window of each text."""
    hashed, at = word_hashes(column)
    seeds, at = mix(grams(hashed, seed)), at.tolist()
    return [sliding_min(seeds[a : max(a, b - seed + 1)], window - seed + 1) for a, b in zip(at, at[1:])]


def windows_of(column: pa.Array, window: int) -> list[np.ndarray]:
    """The hash of each window of each text."""
    hashed, at = word_hashes(column)
    whole, at = grams(hashed, window), at.tolist()
    return [whole[a : max(a, b - window + 1)] for a, b in zip(at, at[1:])]


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """For each document that loses words: key, text_hash, n_words, n_removed, kept (text), spans
    (starts and ends in words of the maximal repeats)."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def seeds(batches):
        for batch in text_blocks(batches):
            keys, found = [], []
            for k, a in zip(batch["key"].to_pylist(), anchors(batch["text"], window, seed)):
                if len(a):
                    a = np.unique(a)
                    keys.append(np.full(len(a), k, np.int64))
                    found.append(a)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), pa.array(np.concatenate(keys))], ["anchor", "key"])

    found = stored(rows.mapInArrow(seeds, "anchor long, key long"), "anchors")
    shared = stored(found.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("anchor"), "shared")
    wanted = stored(found.join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "wanted")
    discard(found)
    discard(shared)
    touched = stored(rows.join(wanted, "key"), "touched")
    discard(wanted)

    def extend(batches):
        for batch in text_blocks(batches):
            keys, found, at = [], [], []
            both = zip(anchors(batch["text"], window, seed), windows_of(batch["text"], window))
            for k, (anchor, whole), wanted in zip(batch["key"].to_pylist(), both, batch["anchors"].to_pylist()):
                anchor = signed(anchor)
                mine = np.isin(anchor, np.array(wanted, np.int64))
                w, first = np.unique(whole[mine], return_index=True)
                first.sort()
                keys.append(np.full(len(w), k, np.int64))
                found.append(signed(whole[mine])[first])
                at.append(anchor[mine][first])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (at, found, keys)], ["anchor", "whole", "key"])

    windows = stored(touched.mapInArrow(extend, "anchor long, whole long, key long"), "windows")
    least = windows.groupBy("anchor", "whole").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("anchor", "whole", "lo")
    least = stored(least, "least")
    repeated = stored(windows.join(least, ["anchor", "whole"]).where("key > lo").groupBy("key").agg(F.collect_set("whole").alias("repeated")), "repeated")
    discard(windows)
    discard(least)

    def cut(batches):
        for batch in text_blocks(batches):
            out = []
            for k, h, t, whole, repeated in zip(batch["key"].to_pylist(), batch["text_hash"].to_pylist(), binary_list(batch["text"]), windows_of(batch["text"], window), batch["repeated"].to_pylist()):
                words = t.split()
                starts = np.flatnonzero(np.isin(signed(whole), np.array(repeated, np.int64)))
                if not len(starts):
                    continue
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()
                out.append((k, h, len(words), int(gone.sum()), kept, turns[::2].tolist(), turns[1::2].tolist()))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, types)], ["key", "text_hash", "n_words", "n_removed", "kept", "starts", "ends"])

    once = touched.select("key", F.xxhash64("text").alias("text_hash"), "text").join(repeated, "key").dropDuplicates(["key", "text_hash"])
    return once.mapInArrow(cut, "key long, text_hash long, n_words long, n_removed long, kept string, starts array<int>, ends array<int>")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with repeated words cut out (``n_chars``, if there, follows).

    Texts that lose nothing stay as they are; a text that loses every word goes.
    """
    k, h, cut = "__oddgraph_key", "__oddgraph_text", "__oddgraph_cut"
    hit = stored(removals(docs.select(key, text), key, text, window).select(F.col("key").alias(k), F.col("text_hash").alias(h), F.col("kept").alias(cut)), "kept")
    marked = docs.withColumns({k: F.col(key).cast("long"), h: F.xxhash64(text)})
    joined = marked.join(hit, [k, h], "left").where(F.col(cut).isNull() | (F.col(cut) != ""))
    chosen = {text: F.coalesce(cut, text)}
    if "n_chars" in docs.columns:
        chosen["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.char_length(cut)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[chosen.get(c, F.col(c)).alias(c) for c in docs.columns])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lost = removals(docs).select(F.col("key").alias("doc_id"), F.col("text_hash"), "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), lambda w: w != "")
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words.alias("_w")).select(
        "doc_id", "text_hash", F.size("_w").cast("long").alias("n_words"), F.sha2(F.concat_ws(" ", "_w"), 256).alias("whole_sha256")
    )
    return whole.join(lost, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256")
    )
