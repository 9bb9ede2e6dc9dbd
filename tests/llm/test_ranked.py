"""Ranked search against a plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oddgraph.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    """docs and items: (id, text)."""
    counts = [Counter(terms(t)) for _, t in docs]
    total, length = sum(bool(c) for c in counts), sum(map(len, (terms(t) for _, t in docs)))
    df = Counter(t for c in counts for t in c)
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = set()
    for i, q in asked.items():
        found = []
        for (doc, _), c in zip(docs, counts):
            n, s = sum(c.values()), 0
            for t, times in q.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    s += times * w * (1000000000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * total // length)))
            if s > 0:
                found.append((-s, doc is None, doc))
        out |= {(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)] + ["Été", "ß", "日本", "Straße7"]
    draw = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    texts = [draw(rng.randrange(1, 90)) for _ in range(260)]
    texts += [texts[0]] * 40 + [t + " w1" for t in [texts[1]] * 25] + [None, "", " . ", "w1 " * 4000, draw(9000)]
    docs = list(enumerate(texts)) + [(7, texts[3]), (7, texts[3]), (None, texts[0])]
    items = [(i, draw(rng.randrange(1, 30))) for i in range(25)] + [(25, texts[0]), (26, texts[1]), (27, None), (28, "..."), (29, "unheard of"), (30, "w1 w1 w1"), (None, "w1"), (3, "w2 w3")]
    return docs, items


@pytest.mark.parametrize(("k", "held", "bucket", "pairs", "chunk"), [(20, 10**6, 8192, 1 << 18, 1 << 18), (3, 0, 20, 150, 50), (8, 10**6, 3, 1000, 7)])
def test_against_plain_scoring(spark, monkeypatch, k, held, bucket, pairs, chunk):
    monkeypatch.setattr(ranked, "CHUNK", chunk)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for c in ("rank", "score", "term", "rep", "n", "kind", "id", "gain"):
        d = d.withColumn(c, F.lit(1))
    got = [tuple(r) for r in ranked.searched(d, spark.createDataFrame(items, "item_id long, text string"), k, held_terms=held, bucket=bucket, pairs=pairs).collect()]
    assert len(got) == len(set(got)) or k == 20  # copies of equal id may tie
    assert set(got) == plain(docs, items, k)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert ranked.searched(docs.where("false"), items).count() == 0
    assert ranked.searched(docs, items.where("false")).count() == 0
    assert [tuple(r) for r in ranked.searched(docs, items).collect()] == [(1, 1, 1, 2 * 287 * (1000000000 // (1000 + 1200)))]
