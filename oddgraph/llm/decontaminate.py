"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Training texts are cut into overlapping passages. Items are indexed by length, those of up to 2, 4, 8, ...
words apart, and searched with passages of twice that length, so every copy of an item lies whole in one
and an item's passages depend on its own length alone. Each passage queries the index and retrieves all
items above a threshold. Impacts are BM25 weights (document frequencies counted over all training
documents, the mean length over the whole benchmark) divided by the item's own total, so the threshold is a share of the item. Before a list is opened, MaxScore's bound applies: an item can only
reach the threshold with one of its essential terms, those outside the largest set of its weakest
terms that stays below it; passages without any essential term are skipped, exactly.

Retrieved items are verified: the share of the item's question found in the passage by runs of five
words must reach ``LEAST_OVERLAP``, and that of its answer (the last sentence, runs of up to five words) too.

The index is broadcast in groups of at most about ``GROUP_ITEMS`` items; a larger benchmark takes more passes, none
is cut, and groups don't change results. Defined results: null and empty texts match nothing; items without words are left out; equal
items each match; repeated rows give repeated results; an empty benchmark matches nothing; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, LEAST_OVERLAP, RUN = 0.7, 0.8, 5
K1, B, BLOCK, GROUP_ITEMS, SLACK = 1.2, 0.75, 8, 20_000, 1e-9
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.?!]\s+|\n+")


#: For texts within Latin-1: lower case, everything but letters and digits a space.
_TABLE = bytes(ord(c.lower()) if c.isalnum() and ord(c.lower()) < 256 else 32 for c in map(chr, range(256)))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, lower case, as Latin-1 where that can hold them."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(_TABLE).split()
    except UnicodeEncodeError:
        return [w.encode("latin-1") if max(w) < "\u0100" else b"\0" + w.encode() for w in _WORD.findall(text.lower())]


def runs(words: list[bytes], size: int = RUN) -> set[tuple[bytes, ...]]:
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence with words is the answer if words stand before it."""
    parts = [p for p in map(words_of, _SENTENCE.split(text)) if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


class Index:
    """Postings with normalised impacts, the maxima of their blocks of items, and the essential postings.
    ``mean`` is the benchmark's mean length, ``step`` half a passage; without them those of the items serve."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], documents: int, threshold: float = THRESHOLD, mean: float | None = None, step: int | None = None):
        self.threshold = threshold
        self.ids, self.parts, counts = [], [], []
        for i, text in items:
            if c := Counter(words_of(text)):
                self.ids.append(i)
                q, a = question_and_answer(text)
                self.parts.append((runs(q), runs(a), len(q), len(a)))
                counts.append(c)
        self.step = step or max((sum(c.values()) for c in counts), default=1)
        mean = mean or sum(sum(c.values()) for c in counts) / max(1, len(counts))
        self.impacts: dict[bytes, dict[int, float]] = {}
        self.blocks: dict[bytes, dict[int, float]] = {}
        self.essential: dict[bytes, list[int]] = {}
        for n, c in enumerate(counts):
            length = sum(c.values())
            weight = {
                w: math.log(1 + (documents - frequency.get(w, 0) + 0.5) / (frequency.get(w, 0) + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
                for w, f in c.items()
            }
            total, below = sum(weight.values()), 0.0
            for w in sorted(weight, key=lambda w: (weight[w], w)):
                share = weight[w] / total
                below += share
                if below >= threshold - SLACK:
                    self.essential.setdefault(w, []).append(n)
                self.impacts.setdefault(w, {})[n] = share
                blocks = self.blocks.setdefault(w, {})
                blocks[n // BLOCK] = max(share, blocks.get(n // BLOCK, 0.0))

    def search(self, words: set[bytes]) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with score >= threshold, item at a time.

        Pivots are the items of essential postings, the only ones that can reach the threshold. The
        block maxima bound all items of a pivot's block: below the threshold the block is skipped.
        """
        pivots = sorted({n for w in words if w in self.essential for n in self.essential[w]})
        if not pivots:
            return []
        terms, found, block, open_block = [w for w in words if w in self.impacts], [], -1, False
        for n in pivots:
            if n // BLOCK != block:
                block = n // BLOCK
                open_block = sum(self.blocks[w].get(block, 0.0) for w in terms) >= self.threshold - SLACK
            if open_block:
                score = sum(self.impacts[w].get(n, 0.0) for w in terms)
                if score >= self.threshold - SLACK:
                    found.append((n, score))
        return found

    def matches(self, words: list[bytes]) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, first word of the passage), the best of each item."""
        step, essential = self.step, self.essential
        hits = [i for i, w in enumerate(words) if w in essential]
        passages = sorted({p for i in hits for p in (i // step - 1, i // step) if p >= 0})
        best: dict[int, tuple] = {}
        for p in passages:
            passage = words[p * step : (p + 2) * step]
            for n, score in self.search(set(passage)):
                q, a, lq, la = self.parts[n]
                oq = len(q & runs(passage, min(RUN, lq))) / len(q)
                oa = len(a & runs(passage, min(RUN, la))) / len(a) if a else 1.0
                if oq >= LEAST_OVERLAP and oa >= LEAST_OVERLAP and score > best.get(n, (0, 0.0))[1]:
                    best[n] = (self.ids[n], score, oq, oa, p * step)
        return [best[n] for n in sorted(best)]


def by_length(items: list[tuple[int, str]], frequency: dict[bytes, int], documents: int, threshold: float, mean: float) -> list[Index]:
    """An index for the items of each class of lengths: up to 1, 2, 4, ... words."""
    classes: dict[int, list[tuple[int, str]]] = {}
    for i, text in items:
        if n := len(words_of(text)):
            classes.setdefault(1 << (n - 1).bit_length(), []).append((i, text))
    return [Index(classes[step], frequency, documents, threshold, mean, step) for step in sorted(classes)]


def mean_length(items: DataFrame) -> float:
    """Words of an item with words, over all items."""

    def count(batches):
        for batch in batches:
            n = [len(words_of(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n)], pa.int64()), pa.array([sum(map(bool, n))], pa.int64())], ["words", "items"])

    got = items.select("text").mapInArrow(count, "words long, items long").agg(F.sum("words").alias("words"), F.sum("items").alias("items")).first()
    return (got["words"] or 0) / max(1, got["items"] or 0)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, group_items: int = GROUP_ITEMS) -> DataFrame:
    """key, text_hash, item_id, score, question, answer, start: one row per document and item."""
    sc = docs.sparkSession.sparkContext
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    groups, mean = max(1, -(-items.count() // group_items)), mean_length(items)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, text_hash long, item_id long, score double, question double, answer double, start long"
    out = None
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text")
        held = [(r["item_id"], r["text"]) for r in part.collect()]  # a bounded group of the benchmark
        vocabulary = sc.broadcast({w for _, t in held for w in words_of(t)})

        def count(batches, vocabulary=vocabulary):
            found, n = Counter(), 0
            for batch in batches:
                for t in batch["text"].to_pylist():
                    n += 1
                    found.update(vocabulary.value.intersection(words_of(t)))
            yield pa.RecordBatch.from_arrays([pa.array([*found, None], pa.binary()), pa.array([*found.values(), n], pa.int64())], ["word", "n"])

        counts = rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        frequency = {r["word"] and bytes(r["word"]): r["n"] for r in counts}
        index = sc.broadcast(by_length(held, frequency, frequency.pop(None, 0), threshold, mean))

        def find(batches, index=index):
            for batch in batches:
                at, got = [], []
                for i, t in enumerate(batch["text"].to_pylist()):
                    words = words_of(t)
                    for part in index.value:
                        for m in part.matches(words):
                            at.append(i)
                            got.append(m)
                cols, at = list(zip(*got)) or [()] * 5, pa.array(at, pa.int64())
                types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].take(at), batch["text_hash"].take(at), *(pa.array(c, x) for c, x in zip(cols, types))],
                    ["key", "text_hash", "item_id", "score", "question", "answer", "start"],
                )

        found = rows.mapInArrow(find, schema)
        out = found if out is None else out.union(found)
    return out


def verdicts(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents' keys with contaminated, n_items, item_ids and max_score."""
    found = matches(docs, benchmark, key, text).groupBy("key", "text_hash").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("max_score")
    )
    all_docs = docs.select(F.col(key).alias(key), F.xxhash64(text).alias("_h"))
    joined = all_docs.join(found, all_docs[key].eqNullSafe(found["key"]) & (all_docs["_h"] == found["text_hash"]), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return joined.select(key, F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, all columns, in one more narrow pass: the matches, a small
    share of the rows, are what is joined."""
    bad = matches(docs, benchmark, key, text).select("key", "text_hash").distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["key"]) & (F.xxhash64(docs[text]) == bad["text_hash"]), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return verdicts(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
