"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and full-width forms to Latin,
digit and sign substitutions to letters, invisible signs removed, everything that is no letter to one
space. The lexicon holds word beginnings and whole words; its weights are the log-odds of a
bounded sample of labelled documents, and every term and exception phrase which that sample yields is kept. A match inside an exception phrase (the word before or after
it, where such pairs stand in clean documents) doesn't count. The document's features are the summed
weight and the summed weight per word, brought to [0, 1] by a logistic curve fitted on the sample.

Defined results: null and empty texts score as a document without a match; a document with several
labels counts as toxic if any says so; without labels of both classes every score is 0; null ids are scored
and never learned from; of entries that match at one word the heaviest counts, of equal ones either;
repeated rows give repeated results; very long texts are matched whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddgraph.llm.common import discard, held_out, stored

TRAIN_DOCS = 6000
SHORTEST, LONGEST = 4, 8
LEAST_DOCS, LEAST_LOG_ODDS = 4, 2.5
#: Log-odds count less this many standard errors, so that chance and copied texts weigh little.
STANDARD_ERRORS = 1.64
CLEAN_PHRASE = 0.9

# Look-alike letters, digit and sign substitutions, invisible signs.
LOOK_ALIKES = dict(zip("аеорсхуіѕјкмтвнԁɡαεικνορτυχο", "aeopcxyisjkmtbhdgaeikvoptuxo"))
SUBSTITUTES = dict(zip("0123456789@$", "oizeasgtbgas"))
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = {ord(a): b for a, b in (LOOK_ALIKES | SUBSTITUTES).items()}
_HIDE = {ord(c): None for c in INVISIBLE}
_GAP = re.compile(r"[\W\d_]+")
#: For texts within Latin-1, by far the most: the same folding as one table over bytes.
_TABLE = bytearray(b" " * 256)
for _i in range(256):
    _c = chr(_i).lower().translate(_FOLD)
    if len(_c) == 1 and ord(_c) < 256 and _c.isalpha():
        _TABLE[_i] = ord(_c)
_TABLE = bytes(_TABLE)


def fold(text: str | None) -> str:
    """The folded words with one space before each."""
    if not text:
        return ""
    if "­" not in text:
        try:
            words = text.encode("latin-1").translate(_TABLE).split()
            return "".join((" ", b" ".join(words).decode("latin-1"))) if words else ""
        except UnicodeEncodeError:
            pass
    text = unicodedata.normalize("NFKC", text.translate(_HIDE)).lower().translate(_FOLD)
    words = _GAP.sub(" ", text).split()
    return " " + " ".join(words) if words else ""


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str]] | frozenset = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        if not self.weights:
            return None
        found.make_automaton()
        return found


def matches(folded: str, lexicon: Lexicon, automaton) -> list[tuple[int, float]]:
    """(start of the word, weight), the heaviest entry of each word, exceptions taken out."""
    best: dict[int, float] = {}
    for end, (length, weight) in automaton.iter(f"{folded} ") if automaton and folded else ():
        start = end - length + 1
        if weight > best.get(start, 0.0):
            best[start] = weight
    if best and lexicon.exceptions:
        best = {s: w for s, w in best.items() if not any(p in lexicon.exceptions for p in pairs_at(folded, s))}
    return sorted(best.items())


def pairs_at(folded: str, start: int) -> list[tuple[str, str]]:
    """The word at start (the place of its space) with the word before and the word after it."""
    end = folded.find(" ", start + 1)
    end = len(folded) if end < 0 else end
    word, out = folded[start + 1 : end], []
    if start > 0:
        out.append((folded[folded.rfind(" ", 0, start) + 1 : start], word))
    if end < len(folded):
        after = folded.find(" ", end + 1)
        out.append((word, folded[end + 1 : after if after >= 0 else len(folded)]))
    return out


def features(folded: str, lexicon: Lexicon, automaton) -> tuple[float, float]:
    total = sum(w for _, w in matches(folded, lexicon, automaton))
    words = folded.count(" ")
    return math.log1p(total), math.log1p(100 * total / words if words else 0.0)


def terms_of(folded: str, exceptions: set[tuple[str, str]] = frozenset()) -> set[str]:
    """Beginnings of SHORTEST..LONGEST letters and whole words, each with its leading space, of the words that
    stand outside exception phrases at least once. Shorter words are whole, between two spaces."""
    words, out = folded.split(), set()
    if exceptions:
        pairs = list(zip(words, words[1:]))
        hidden = {i + k for i, p in enumerate(pairs) if p in exceptions for k in (0, 1)}
        words = [w for i, w in enumerate(words) if i not in hidden]
    for w in set(words):
        if len(w) >= SHORTEST:
            out.update(" " + w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
            out.add(f" {w}")
        else:
            out.add(f" {w} ")
    return out


def _split_counts(names: dict[str, list[str]], counts: Counter, toxic: int) -> pa.RecordBatch:
    n, none = pa.array(list(counts.values()), pa.int64()), pa.array([0] * len(counts), pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.string()) for x in names.values()), none if toxic else n, n if toxic else none], [*names, "n0", "n1"]
    )


def _counts(sample: DataFrame, exceptions: set[tuple[str, str]] = frozenset()) -> DataFrame:
    def count(batches):
        found = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                found[int(toxic)].update(terms_of(fold(text), exceptions))
        for toxic, got in enumerate(found):
            yield _split_counts({"term": list(got)}, got, toxic)

    return sample.mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _phrases(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    def count(batches):
        automaton, found = lexicon.automaton(), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                folded = fold(text)
                found[int(toxic)].update({p for s, _ in matches(folded, lexicon, automaton) for p in pairs_at(folded, s)})
        for toxic, got in enumerate(found):
            yield _split_counts({"a": [p[0] for p in got], "b": [p[1] for p in got]}, got, toxic)

    return sample.mapInArrow(count, "a string, b string, n0 long, n1 long").groupBy("a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a light ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b)


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", bound: int = TRAIN_DOCS) -> Lexicon:
    """Learn lexicon, exceptions and curve from at most ``bound`` labelled documents of each class.

    The sample is chosen by a hash of the id and written once; its ids are the only thing broadcast, so their number is bounded.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(train)
    chosen = [
        known.where(F.col("toxic") == c).orderBy(F.xxhash64(F.col(key), F.lit(97)), key).limit(bound) for c in (0, 1)
    ]
    rows = chosen[0].union(chosen[1]).toPandas()
    n = rows["toxic"].value_counts()
    if len(n) < 2:
        return Lexicon(curve=(-30.0, 0.0, 0.0))
    picked = F.broadcast(spark.createDataFrame(rows))
    sample = stored(docs.select(F.col(key).alias(key), F.col(text).alias("text")).join(picked, key).select("text", F.col("toxic").cast("int").alias("toxic")), "toxic-sample")
    spread = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    odds = F.log((F.col("n1") + 0.5) * (int(n[0]) + 1) / ((F.col("n0") + 0.5) * (int(n[1]) + 1))) - STANDARD_ERRORS * spread

    def terms(exceptions: set[tuple[str, str]], least: float) -> Lexicon:
        found = (
            _counts(sample, exceptions).withColumn("w", odds).where((F.col("n1") >= LEAST_DOCS) & (F.col("w") >= least))
            .select("term", "w").toPandas()
        )
        weights: dict[str, float] = {}
        for term, w in sorted(zip(found["term"], found["w"]), key=lambda x: (len(x[0]), x[0])):
            shorter = max((weights.get(term[:k], 0.0) for k in range(SHORTEST + 1, len(term))), default=0.0)
            if not shorter or w > shorter + 0.7:
                weights[term] = float(w)
        return Lexicon(weights, exceptions)

    # Exception phrases first, around all terms that lean to toxic; then the weights without them.
    clean = (F.col("n0") >= LEAST_DOCS) & (F.col("n0") >= CLEAN_PHRASE * (F.col("n0") + F.col("n1")))
    phrases = _phrases(sample, terms(frozenset(), 0.0)).where(clean)
    lexicon = terms({(r["a"], r["b"]) for r in phrases.collect()}, LEAST_LOG_ODDS)

    def measure(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            xs = [features(fold(t), lexicon, automaton) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in xs], pa.float64()) for i in (0, 1)] + [batch["toxic"]], ["x", "z", "toxic"])

    seen = sample.mapInArrow(measure, "x double, z double, toxic int").toPandas()
    discard(sample)
    if seen["toxic"].nunique() < 2:
        return Lexicon(curve=(-30.0, 0.0, 0.0))
    lexicon.curve = _logistic(seen[["x", "z"]].to_numpy(), seen["toxic"].to_numpy())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score and n_matches beside the key."""

    def run(batches):
        automaton, (a, b, c) = lexicon.automaton(), lexicon.curve
        for batch in batches:
            xs = [features(fold(t), lexicon, automaton) for t in batch["text"].to_pylist()]
            s = [1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * z)))) for x, z in xs]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(s, pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
