"""Fill-in-the-middle against plain regular expressions, and its round trip."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddgraph.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    units = UNIT.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text or ""
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    signs = [" ", "\n", "\t", "\x0b", "<", "P", "S", "M", ">", "a", "bc", "ß", "語", "😀", " ", "<P", "<<S>"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    out += ["word " * rng.randrange(1, 400) for _ in range(30)] + ["ü" * 700 + " end", " \n ", "", None, "<P>", "a <", "P> <S", "x" * 5000, "same text twice", "same text twice"]
    return out


def test_against_regular_expressions(spark, documents):
    ts = texts()
    got = middle.transformed(documents(ts).repartition(3)).withColumn("back", middle.restored(F.col("form"), F.col("output")))
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(i, t), t
        assert r["back"] == (t or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "one two three"), (None, "one two three"), (5, "a b"), (5, "c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["output"]) for r in middle.transformed(docs).collect())
    want = sorted((str(i), *[plain(i, t)[k] for k in (0, 1, 4)]) for i, t in rows)
    assert got == want
    assert middle.transformed(docs.where("false")).count() == 0


@pytest.mark.parametrize("lane", [1, 2, 7, 256])
def test_lanes_do_not_matter(lane):
    """Counts and places are those of a plain scan, however long the lanes are."""
    ts = [(t or "").encode() for t in texts()[:80]]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in ts])])
    scan = middle.Scan(np.frombuffer(b"".join(ts), np.uint8), ends, lane)
    for k, t in enumerate(ts):
        a, b, text = int(scan.starts[k]), int(scan.stops[k]), t.decode()
        first = scan.before(middle.UNIT, a)
        found = [scan.find(middle.UNIT, first + u) - a for u in range(scan.before(middle.UNIT, b) - first)]
        assert found == [len(text[: m.start()].encode()) for m in UNIT.finditer(text)]
        assert scan.before(middle.SIGN, b) - scan.before(middle.SIGN, a) == len(text)
        sentinels = scan.before(middle.SENTINEL, b) - scan.before(middle.SENTINEL, a)
        assert sentinels == len(re.findall("<[PSM]>", text))


def test_rates(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    forms = {r["form"] for r in middle.transformed(docs, rate=100, spm_share=0).select("form").distinct().collect()}
    assert forms == {"psm"}
