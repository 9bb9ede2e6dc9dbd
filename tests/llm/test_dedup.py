"""Near-duplicate operators, substring dedup and sharding against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddgraph.llm import jaccard, repeats, sharding, vectors
from oddgraph.llm.components import components


def closed(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def words(rng, n, base=400):
    return [f"w{rng.randrange(base)}" for _ in range(n)]


def near_texts(rng):
    """Groups of near copies (some of chains), exact copies, a shared passage, unrelated and tiny texts."""
    texts, passage = [], " ".join(words(rng, 60))
    for _ in range(3):
        t = words(rng, 120)
        for _ in range(30):
            c = list(t)
            for _ in range(rng.randrange(0, 5)):
                c[rng.randrange(len(c))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(c))
            if rng.random() < 0.2:
                t = c
    texts += [" ".join(words(rng, 90)) + " " + passage for _ in range(40)]
    texts += [" ".join(words(rng, rng.randrange(1, 9), 5)) for _ in range(30)]
    return texts + texts[:5] + [None, "", " \n", "One", "one", "b c", "B\tC", "x y z q " * 3000]


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_jaccard_join(spark, documents, size, num, den):
    texts = near_texts(random.Random(5))
    s = [sets(t, size) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j])]
    want = closed(len(texts), links)
    docs = documents(texts).repartition(3)
    for leaf, pool in ((4, 1.7), (2, 0.5)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(docs, size=size, num=num, den=den, leaf=leaf, pool=pool).collect()}
        assert got == {i: (len(s[i]), want[i]) for i in range(len(texts))}
    kept = jaccard.representatives(docs, size=size, num=num, den=den)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w for i, w in enumerate(want)}) and kept.columns == docs.columns


def test_jaccard_join_of_nothing(spark, documents):
    assert jaccard.joined(documents([])).count() == 0
    assert jaccard.joined(documents([None, ""])).where("component_id = doc_id").count() == 2


def test_grams_and_minima():
    x = np.arange(40, dtype=np.uint64) * 7919 % 101
    for k in (1, 2, 5, 25):
        g = jaccard.grams(x, k)
        assert len(g) == 41 - k and len(set(g.tolist())) == len({tuple(x[i : i + k]) for i in range(41 - k)})
        assert repeats.sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(41 - k)]
    assert len(jaccard.grams(x[:3], 5)) == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(40, i) for i in range(41, 60)] + [(70, 70)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 40 for i in range(40, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(spark, documents):
    rng = random.Random(9)
    shared, half = words(rng, 80), words(rng, 49)
    texts = [" ".join(words(rng, 70) + (shared if i % 2 else half) + words(rng, 40) + (shared[20:75] if i % 3 == 0 else [])) for i in range(24)]
    texts += [texts[3], None, "", " ".join(shared) + "\x0b" + "\xa0", "line again " * 200, "line again " * 60, " ".join(shared[:50]), "q " * 49, "q " * 50]
    first, want = {}, {}
    for i, t in enumerate(texts):
        w, gone = (t or "").encode().split(), set()
        for a in range(len(w) - 49):
            if first.setdefault(tuple(w[a : a + 50]), i) < i:
                gone.update(range(a, a + 50))
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    docs = documents(texts).repartition(3)
    got = {r["key"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.removals(docs).collect()}
    assert got == {i: x for i, x in want.items() if x[1]}
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        n, gone, kept = want[r["doc_id"]]
        assert r["text"] == (kept if gone else texts[r["doc_id"]]) and (not gone or r["n_chars"] == len(kept))
    assert {r["doc_id"] for r in out.collect()} == {i for i, (n, g, kept) in want.items() if not g or kept}
    null_id = docs.withColumn("doc_id", F.when(F.col("doc_id") < 20, F.col("doc_id")))
    assert repeats.without_repeats(null_id).count() == len(texts) and repeats.removals(documents([])).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    v = [(base[i % 6] + 0.16 * rng.standard_normal(16)).tolist() for i in range(120)] + rng.standard_normal((60, 16)).tolist()
    v += [v[0], [2 * x for x in v[1]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [1.0, 2.0], v[2], [1e308] * 16]
    labels = [i % 2 for i in range(len(v) - 2)] + [None, 1]
    rows = [(i, x, g) for i, (x, g) in enumerate(zip(v, labels))]
    ok = [g is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x) for _, x, g in rows]
    unit = [np.array(x) / np.abs(x).max() / np.linalg.norm(np.array(x) / np.abs(x).max()) if k else None for (_, x, _), k in zip(rows, ok)]
    links = [(i, j) for i in range(len(v)) for j in range(i) if ok[i] and ok[j] and labels[i] == labels[j] and len(v[i]) == len(v[j]) and unit[i] @ unit[j] >= 0.93]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(0)).withColumn("n", F.lit(0)).repartition(3)
    want, degree = closed(len(v), links), [sum(i in x for x in links) for i in range(len(v))]
    block = vectors.BLOCK
    try:
        for size in (block, 8):
            vectors.BLOCK = size
            got = {r["vec_id"]: tuple(r)[1:] for r in vectors.near_duplicates(df, recall=1 - 1e-9).collect()}
            assert got == {i: (degree[i], want[i], want[i] == i) for i in range(len(v))}
    finally:
        vectors.BLOCK = block
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_sharding(spark, documents):
    texts = [f"text {i}" * (i % 7) for i in range(203)] + [None, "", "é" * 40000]
    docs = documents(texts)
    docs = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.shard_rows(docs, 8).collect()
    assert len(rows) == docs.count() and sorted(r["row_no"] for r in rows) == list(range(len(rows)))
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert all((r["shard"], r["slot"]) == (r["position"] % 8, r["position"] // 8) for r in rows)
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    assert all(sizes[i] == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    again = sharding.shard_rows(docs.repartition(7), 8).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert sharding.shard_rows(docs.where("false"), 8).count() == 0 and sharding.shard_rows(docs.limit(1), 8).first()["position"] == 0


@pytest.mark.parametrize("n", [2, 3, 5, 17, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = spark.range(n).select(sharding.permuted(F.col("id"), n, 3).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


@pytest.mark.parametrize(("size", "num", "den", "least"), [(4, 85, 100, 6), (5, 4, 5, 4)])
def test_jaccard_join_links_the_smallest_sets_with_their_supersets(spark, documents, size, num, den, least):
    """A set whose every shingle is needed still links with the set of one shingle more, and chains run through it."""
    texts = []
    for g in range(4):
        w = [f"g{g}x{i}" for i in range(least + size)]
        texts += [" ".join(w[:-1]), " ".join(w), " ".join(w[1:])]
        short = [f"s{g}x{i}" for i in range(least + size - 1)]  # one shingle less than the least set: no link
        texts += [" ".join(short[:-1]), " ".join(short[:-2])]
    s = [sets(t, size) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if den * len(s[i] & s[j]) >= num * len(s[i] | s[j])]
    expected = closed(len(texts), links)
    assert {(len(s[i]), len(s[j])) for i, j in links} >= {(least + 1, least), (least, least + 1)}
    got = jaccard.joined(documents(texts), size=size, num=num, den=den).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(expected))


def thue_morse(n):
    """Two words of n signs over a and b that differ at every sign."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_of_equal_polynomials_are_told_apart(spark, documents, n):
    """Words on which a polynomial hash modulo a power of two collides, through both operators and both stages."""
    import corpus_pipeline

    one, two = thue_morse(n)
    docs = documents([" ".join([one] * 60), " ".join([two] * 60), " ".join([one, two] * 30)], extra=False)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs).collect()} == {0: 0, 1: 1, 2: 2}
    assert repeats.removals(docs).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:3]:
        got = {r["doc_id"]: r["text"] for r in stage(spark, docs, "").collect()}
        assert got == {r["doc_id"]: r["text"] for r in docs.collect()}, name


def test_words_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    from oddgraph.llm import common

    texts = ["", None, "a  bb\tccc\n", "x" * 50, " lead and trail ", "ünï cödé \x0b\x0c words", "one two three " * 40]
    whole, at = common.word_hashes(pa.array(texts), True)
    monkeypatch.setattr(common, "_PIECE", 7)
    monkeypatch.setattr(common, "_WORDS", 3)
    pieces, where = common.word_hashes(pa.array(texts), True)
    assert whole.tolist() == pieces.tolist() and at.tolist() == where.tolist()
    assert np.diff(at).tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(whole.tolist())) == len({w for t in texts for w in (t or "").encode().lower().split()})
    assert not len(common.word_hashes(pa.array([], pa.string()))[0])


def test_jaccard_join_of_groups_with_outliers_and_common_passages(spark, documents):
    """Groups of near copies with far outliers and cut copies, and texts made of the same few passages."""
    rng, texts = random.Random(1), []
    for g in range(2):
        t = [f"g{g}w{rng.randrange(900)}" for _ in range(120)]
        for _ in range(60):
            c = list(t)
            for _ in range(rng.randrange(0, rng.choice([3, 8, 20]))):
                c[rng.randrange(len(c))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(c[: rng.randrange(60, 120)] if rng.random() < 0.2 else c))
    passages = [[f"p{k}w{i}" for i in range(20)] for k in range(8)]
    texts += [" ".join(w for k in rng.sample(range(8), 5) for w in passages[k]) for _ in range(60)]
    s = [sets(t, 4) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(documents(texts).repartition(3), leaf=3).collect()}
    assert got == dict(enumerate(closed(len(texts), links)))
