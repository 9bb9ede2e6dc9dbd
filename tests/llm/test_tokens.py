"""Wavelet shards and packing: exact round trips."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oddgraph.llm import packing, wavelet
from oddgraph.llm.encode import Encoder

TEXTS = ["the cat sat", None, "", "a  b\n\n c", "It's we'LL 12³4 …", "naïve Σίσυφος 日本 text", "x " * 5000, "the cat sat", "don't\n\n\n", " 's", "<|endoftext|> é\x00\x1f ok\xa0z"]


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_equals_the_library(file, kind):
    e = Encoder(P.path(file), kind)
    texts = [t or "" for t in TEXTS] + ["Ünï¼ª² 'RE I'm", "tab\tnew\r\nline  ", "ÀÈß{}[]!? --- 100,000.5"]
    assert [e(t) for t in texts] == e.whole(texts)
    assert [e(t) for t in texts] == e.whole(texts)


@pytest.mark.parametrize(("file", "kind", "ends"), [("word_bpe_49k.json", "word", 49407), ("byte_bpe_50k.json", "byte", 50256)])
def test_encoder_keeps_the_librarys_default_for_added_tokens(file, kind, ends):
    e, fresh = Encoder(P.path(file), kind), Tokenizer.from_file(P.path(file))
    texts = ["end <|endoftext|> go", "<|endoftext|>", "a<|EndOfText|>b", "<|startoftext|> it's <|endoftext|><|endoftext|>", "é <|endoftext|> 日本", "<|endoftext", "plain"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert ends in want[0] and [np.frombuffer(e(t), "<u4").tolist() for t in texts] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in e.whole(texts)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=300))
def test_wavelet_matrix(values):
    v = np.array(values, np.uint32)
    w = wavelet.WaveletMatrix.build(v)
    assert (w.decode() == v).all()
    for x in {0, 70001, *values[:5]}:
        at = np.flatnonzero(v == x)
        assert w.count(x) == len(at) and w.rank(x, len(v) // 2) == (v[: len(v) // 2] == x).sum()
        assert [w.select(x, j) for j in range(len(at))] == at.tolist() and w.select(x, len(at)) == -1
    assert [w.access(i) for i in range(min(20, len(v)))] == values[:20]
    ids, ends, again = wavelet.open_shard(wavelet.pack_shard([None, 7], [0, len(v)], v))
    assert ids == [None, 7] and ends.tolist() == [0, len(v)] and (again.decode() == v).all()


def test_shards(spark, documents):
    docs = documents(TEXTS).orderBy(F.desc("doc_id"))
    shards = wavelet.write_shards(docs, P.path("word_bpe_49k.json"), shard_tokens=20)
    rows = wavelet.read_documents(shards).orderBy("doc_id").collect()
    e, at = Encoder(P.path("word_bpe_49k.json"), ""), 0
    assert shards.count() > 2 and len(rows) == len(TEXTS)
    for r, t in zip(rows, TEXTS):
        want = e(t or "") + (2).to_bytes(4, "little")
        assert (bytes(r["ids"]), r["start"], r["n_tokens"], r["ids_crc32"]) == (want, at, len(want) // 4, zlib.crc32(want))
        at += len(want) // 4


def test_shards_of_nothing_and_of_nulls(spark, documents):
    assert wavelet.read_documents(wavelet.write_shards(documents([]), P.path("word_bpe_49k.json"))).count() == 0
    odd = documents(["a", "a", None]).withColumn("doc_id", F.when(F.col("doc_id") > 1, None).otherwise(F.lit(5)))
    assert wavelet.read_documents(wavelet.write_shards(odd, P.path("word_bpe_49k.json"))).count() == 3


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_covers_and_fills(histogram):
    plan, seen = packing.Plan(histogram, 64), {}
    for length, n in histogram.items():
        for rank in range(n):
            parts = plan.place(length, rank)
            assert sum(b - a for a, b, _, _ in parts) == length
            for a, b, s, o in parts:
                seen.setdefault(s, []).append((o, b - a))
    for got in seen.values():
        got.sort()
        assert all(o == sum(n for _, n in got[:i]) for i, (o, _) in enumerate(got)) and sum(n for _, n in got) <= 64
    total = sum(k * n for k, n in histogram.items())
    assert len(seen) * 64 <= total * 1.02 + 64


def test_knapsack_is_best():
    value, pattern = packing.priced(np.array([1.0, 2.2, 2.9]), np.array([3, 5, 7]), 10)
    assert value == pytest.approx(4.4) and pattern == Counter({1: 2})


def test_packing(spark, documents):
    docs = documents(TEXTS * 2)
    rows = packing.packed(packing.pieces(docs, P.path("byte_bpe_50k.json"))).collect()
    e = Encoder(P.path("byte_bpe_50k.json"), "")
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: b"".join(x for _, x in sorted(v)) for d, v in by_doc.items()} == {i: e(t or "") + bytes(4) for i, t in enumerate(TEXTS * 2)}
    for got in by_sequence.values():
        got.sort()
        assert all(o == sum(n for _, n in got[:i]) for i, (o, _) in enumerate(got)) and sum(n for _, n in got) <= 1024
    assert packing.packed(packing.pieces(documents([]), P.path("byte_bpe_50k.json"))).count() == 0


def test_packing_of_null_and_repeated_ids(spark, documents):
    docs = documents(["a b c"] * 3 + [None]).withColumn("doc_id", F.when(F.col("doc_id") > 0, None).otherwise(7).cast("long"))
    rows = packing.packed(packing.pieces(docs, P.path("byte_bpe_50k.json"))).collect()
    assert sum(r["length"] for r in rows) == 3 * 4 + 1 and sum(r["doc_id"] == 7 for r in rows) >= 1
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_patterns_hold_nearly_all_pieces():
    """Against the bound of the linear program, which is all ids over the room: nothing can be packed tighter."""
    rng = np.random.default_rng(4)
    for docs, most in ((300, 0.01), (3000, 0.002)):
        histogram = Counter(n for x in rng.lognormal(6.4, 0.9, docs).astype(int) + 1 for n in packing.cuts(int(x), 1024))
        padding, in_patterns = packing.waste(histogram)
        lengths = np.array(sorted(x for x in histogram if x < 1024))
        _, used = packing.linear_program(lengths, np.array([histogram[int(x)] for x in lengths], float), 1024)
        bound = sum(int(x) * histogram[int(x)] for x in lengths) / 1024
        assert bound - 1e-6 <= used.sum() <= bound * 1.003
        short = Counter({x: n for x, n in histogram.items() if x < 1024})
        assert padding < most and in_patterns > 0.97 and packing.waste(short)[1] > 0.95
