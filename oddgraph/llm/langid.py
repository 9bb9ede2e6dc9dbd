"""Language identification by word-first backoff.

Known words are scored by their log frequency in each language; a word that was not seen falls back
to its character n-grams (with word ends marked), the longest length of which any gram is known,
from four signs down to one. A document's score per language is the sum over its words.

The model is fitted on a bounded sample: about ``TRAIN_DOCS`` documents of each language (a draw by a hash
of the id with that expectation), so it behaves alike at every size; of the sample every word and
n-gram that occurs twice is kept. It is two arrays, 64-bit hashes and log frequencies, so that a worker
holds a few megabytes. Prediction reads every word of every text.

Defined results: a null text or one without a letter is ``und`` with score 0; with no labelled
document at all every text is ``und``; ties go to the language that sorts first; repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddgraph.llm.common import held_out, text_blocks

TRAIN_DOCS = 2000
LONGEST, LEAST_COUNT = 4, 2
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def item_hash(item: str, kind: int) -> int:
    """kind: 0 for words, else the length of the n-gram."""
    return xxhash.xxh3_64_intdigest(item.encode("utf-8", "surrogatepass"), seed=kind)


@dataclass
class Model:
    """languages sorted; ``logs`` holds the log frequencies of the items whose sorted hashes are ``keys``."""

    languages: list[str] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    logs: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))

    def places(self, hashes: list[int]) -> np.ndarray:
        """Row of each hash, -1 where it is unknown."""
        h = np.array(hashes, np.uint64)
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == h, at, -1) if len(self.keys) else np.full(len(h), -1)

    def rows(self, words: list[str]) -> np.ndarray:
        """Log frequencies of each word: its own if it is known, else the mean of its longest known n-grams, else 0."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        at = self.places([item_hash(w, 0) for w in words])
        out[at >= 0] = self.logs[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            grams = [grams_of(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            at = self.places([item_hash(g, n) for gs in grams for g in gs])
            owner, at = owner[at >= 0], at[at >= 0]
            known = np.bincount(owner, minlength=len(left))
            total = np.zeros((len(left), out.shape[1]), np.float64)
            np.add.at(total, owner, self.logs[at])
            out[left[known > 0]] = total[known > 0] / known[known > 0, None]
            left = left[known == 0]
        return out


class Scorer:
    """Scores texts; the rows of words met before are kept in a table of bounded size."""

    LIMIT = 200_000

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)

    def ids_of(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > self.LIMIT:
            self.clear()
        if fresh := list(set(words).difference(self.ids)):
            n = len(self.ids)
            while n + len(fresh) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(fresh)] = self.model.rows(fresh)
            self.ids.update(zip(fresh, range(n, n + len(fresh))))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; the unknown words of all texts are looked up together."""
        split = [words_of(t) if self.width else [] for t in texts]
        ids = self.ids_of([w for ws in split for w in ws])
        out, a = [], 0
        for ws in split:
            if not ws:
                out.append(("und", 0.0))
                continue
            total = self.table[ids[a : a + len(ws)]].sum(axis=0, dtype=np.float64)
            a += len(ws)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())))
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.many([text])[0]


def counted(docs: DataFrame, key: str, text: str, lang: str, train: Column, bound: int) -> DataFrame:
    """Counts (lang, kind, item: its hash, n) over the training sample."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), (F.pmod(F.xxhash64(F.col(key), F.lit(41)), F.lit(1_000_000)) / 1e6).alias("u")
    )
    share = rows.groupBy("lang").agg((F.lit(float(bound)) / F.count("*")).alias("share"))  # one row a language
    sample = rows.join(F.broadcast(share), "lang").where("u < share").drop("u", "share")

    def count(batches):
        found: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                seen = Counter(words_of(text))
                found.setdefault((lang, 0), Counter()).update(seen)
                for w, c in seen.items():
                    for n in range(1, LONGEST + 1):
                        into = found.setdefault((lang, n), Counter())
                        for g in grams_of(w, n):
                            into[g] += c
        for (lang, n), c in found.items():
            items = np.array([item_hash(x, n) for x in c], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([n] * len(c), pa.int32()), pa.array(items), pa.array(list(c.values()), pa.int64())], ["lang", "kind", "item", "n"])

    return sample.mapInArrow(count, "lang string, kind int, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = TRAIN_DOCS) -> Model:
    found = counted(docs, key, text, lang, train, bound).where(F.col("n") >= LEAST_COUNT).toArrow()
    if not found.num_rows:
        return Model()
    names = pa.concat_arrays(found["lang"].chunks).dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    order = np.array([languages.index(x) for x in names.dictionary.to_pylist()])
    column, kind = order[names.indices.to_numpy()], found["kind"].to_numpy()
    keys, at = np.unique(found["item"].to_numpy().view(np.uint64), return_inverse=True)
    counts, kinds = np.zeros((len(keys), len(languages))), np.zeros(len(keys), np.int32)
    counts[at, column], kinds[at] = found["n"].to_numpy(), kind
    counts += 0.5
    for k in np.unique(kinds):
        counts[kinds == k] /= counts[kinds == k].sum(axis=0)
    return Model(languages, keys, np.log(counts).astype(np.float32))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """lang_pred and score beside the key."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in text_blocks(batches):
            out = scorer.many(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["key", "lang_pred", "score"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(score, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose language is told: not ``und`` and of score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        scorer = Scorer(shared.value)
        for batch in text_blocks(batches, text):
            told = scorer.many(batch[text].to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in told], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
