"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

One pass over the documents counts their terms. Equal texts of a chunk of one task become one row, its
representative, with the number of its copies, so a large group of copies costs a posting list entry a
chunk. The postings of the query's terms are dealt by term and by bucket of documents and packed into
list parts, largest gain first; a gain is a document's share of a score that does not depend on the
item, so one list serves all items.

Phase 1 takes the first k of every list, adds them up per item and document, and the k-th best sum is a
lower bound of the item's k-th score. Phase 2 divides it by the number of the item's lists: a document
below that threshold in all lists cannot be among the first k, so every list gives what reaches it, once
for all items, to the task that adds up its bucket of documents. What a document may still get from the
lists that have not shown it (less than the threshold, and no more than the list's first gain) removes
most candidates. Phase 3 looks up the rest's gains in all lists of the item: exact scores.

Defined results: a null or empty text, and one without terms, is in no list and does not count to N; items
are their terms (rows of equal item ids are one item, null ids are left out), an item without terms that
occur gives no rows; equal scores by ascending id, null ids last; repeated rows are documents of their
own; very long texts are read whole; an empty table on either side gives an empty result; extra columns
are ignored. Weights and scores are integers, so results don't depend on the order of sums.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from oddgraph.llm.common import discard, stored, text_blocks

TOP = 20
#: Distinct query terms that tasks may hold as a set; a larger vocabulary is joined instead.
HELD_TERMS = 200_000
#: Documents of a bucket, about: a posting list has one part for each, so no task gets a whole hot list.
BUCKET = 8192
#: Pairs of item and term that are searched at a time; tasks hold them.
PAIRS = 1 << 18
#: Postings of a chunk of one task.
CHUNK = 1 << 18

#: Term signs stay (A-Z as a-z), all others become spaces; UTF-8 bytes beyond ASCII are term signs.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, q: how often)."""
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            for item, t in zip(batch["item_id"], batch["text"].to_pylist()):
                counts = Counter(terms_of(t))
                if counts:
                    terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(counts), batch["item_id"].type), terms, pa.array(list(counts.values()), pa.int64())], ["item_id", "term", "q"])

    return rows.mapInArrow(split, f"item_id {kind}, term string, q long").groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def entered(docs: DataFrame, key: str, text: str, held: set[bytes] | None) -> DataFrame:
    """Three kinds of rows: postings (term, rep, tf, n, copies); documents (rep, id); one (n: terms, copies:
    documents with terms) a chunk. With ``held`` only its terms get postings."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["kind", "term", "rep", "tf", "n", "copies", "id"]

    def enter(batches):
        seen: dict[bytes, int] = {}
        reps, copies, lengths, found, tfs, sizes, pairs, total = [], [], [], [], [], [], [], [0, 0]

        def flush(id_type):
            each, n = np.repeat(np.arange(len(sizes)), sizes), len(found)
            take = lambda x: pa.array(np.array(x, np.int64)[each])
            if n:
                terms = pa.array(found, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(0, pa.int32()), n), terms, take(reps), pa.array(tfs, pa.int64()), take(lengths), take(copies), pa.nulls(n, id_type)], names)
            n = len(pairs)
            if n:
                none = [pa.nulls(n, pa.string()), *[pa.nulls(n, pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(1, pa.int32()), n), none[0], pa.array([r for r, _ in pairs], pa.int64()), *none[1:], pa.array([i for _, i in pairs], id_type)], names)
            one = [pa.nulls(1, pa.string()), *[pa.nulls(1, pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), *one, pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.int64()), pa.nulls(1, id_type)], names)
            for x in (reps, copies, lengths, found, tfs, sizes, pairs):
                x.clear()
            seen.clear()
            total[:] = [0, 0]

        id_type = None
        for block in text_blocks(batches):
            id_type = block["id"].type
            for row, i, t in zip(block["row"].to_pylist(), block["id"].to_pylist(), block["text"].to_pylist()):
                if not t:
                    continue
                digest = xxhash.xxh3_128_digest(t)
                if (k := seen.get(digest)) is None:
                    words = terms_of(t)
                    k = seen[digest] = len(reps)
                    counts = Counter(words)
                    mine = counts.keys() if held is None else counts.keys() & held
                    reps.append(row), copies.append(0), lengths.append(len(words)), sizes.append(len(mine))
                    found.extend(mine), tfs.extend(map(counts.__getitem__, mine))
                if lengths[k]:
                    copies[k] += 1
                    total[0] += lengths[k]
                    total[1] += 1
                    if sizes[k]:
                        pairs.append((reps[k], i))
            if len(found) >= CHUNK or len(pairs) >= CHUNK or len(seen) >= CHUNK:
                yield from flush(id_type)
        if id_type is not None:
            yield from flush(id_type)

    return rows.mapInArrow(enter, f"kind int, term string, rep long, tf long, n long, copies long, id {kind}")


def kth(sums: DataFrame, k: int, value: str, name: str) -> DataFrame:
    """(item_id, name): the k-th largest value of each item, 0 where it has fewer."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(value)))
    first = sums.select("item_id", value).withColumn("_r", rank).where(F.col("_r") <= k)
    return first.groupBy("item_id").agg(F.coalesce(F.max(F.when(F.col("_r") == k, F.col(value))), F.lit(0)).alias(name))


def gain(tf: Column, n: Column, documents: int, length: int) -> Column:
    """(1e9 tf) div (1000 tf + 12 m) with m = 100 - 25 + (25 n N) div L, in 64-bit integers."""
    m = F.lit(75) + _div(n * F.lit(25 * documents), F.lit(length))
    return _div(tf * F.lit(1_000_000_000), tf * 1000 + m * 12)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def packed(rows: DataFrame) -> DataFrame:
    """List parts (term, bucket, df, top, reps, gains), gains falling, from postings (term, bucket, rep, gain, copies)."""
    names = ["term", "bucket", "df", "top", "reps", "gains"]

    def pack(batches):
        held: list[tuple] = []  # the open part: (term, bucket), then slices

        def closed():
            reps, gains, copies = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            return (*held[0][0], int(copies.sum()), int(gains[0]), reps.tobytes(), gains.astype(np.int32).tobytes())

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names)

        for batch in batches:
            if not len(batch):
                continue
            words = batch["term"].dictionary_encode()
            code, bucket = words.indices.to_numpy(), batch["bucket"].to_numpy()
            reps, gains, copies = (batch[c].to_numpy() for c in ("rep", "gain", "copies"))
            starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])))
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(code)]):
                name = (words.dictionary[int(code[a])].as_py(), int(bucket[a]))
                if held and held[0][0] != name:
                    out.append(closed())
                    held.clear()
                held.append((name, reps[a:b], gains[a:b], copies[a:b]))
            if out:
                yield table(out)
        if held:
            yield table([closed()])

    dealt = rows.repartition("term", "bucket").sortWithinPartitions("term", "bucket", F.desc("gain"), "rep")
    return dealt.mapInArrow(pack, "term string, bucket long, df long, top long, reps binary, gains binary")


def unpacked(part: dict, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Representatives and gains of a list part's first ``count`` entries."""
    return np.frombuffer(part["reps"], np.int64)[:count], np.frombuffer(part["gains"], np.int32)[:count].astype(np.int64)


def first_entries(lists: DataFrame, k: int) -> DataFrame:
    """(term, rep, gain): the first k of every list, from the first k of its parts."""

    def first(batches):
        for batch in batches:
            for part in batch.to_pylist():
                reps, gains = unpacked(part, k)
                yield pa.RecordBatch.from_arrays([pa.array([part["term"]] * len(reps)), pa.array(reps), pa.array(gains)], ["term", "rep", "gain"])

    found = lists.select("term", "reps", "gains").mapInArrow(first, "term string, rep long, gain long")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("gain"), "rep"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


class Asked:
    """The items of a block: for each its lower bound and its lists (term, qw, least gain, most of what is below)."""

    def __init__(self, rows: list, kind: pa.DataType, sql: str):
        self.kind, self.sql, self.items, self.least = kind, sql, {}, {}
        for r in rows:
            self.items.setdefault(r["item_id"], (r["bound"], []))[1].append((r["term"], r["qw"], r["least"], r["most"]))
            self.least[r["term"]] = min(r["least"], self.least.get(r["term"], r["least"]))

    def table(self, out: list[tuple], names: list[str]) -> pa.Table:
        """(item, columns...) for each item as one table."""
        ids = pa.array([x[0] for x in out for _ in range(len(x[1]))], self.kind)
        rest = [np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in range(1, len(names) + 1)]
        return pa.table({"item_id": ids, **{c: pa.array(x, pa.int64()) for c, x in zip(names, rest)}})


def fetched(lists: DataFrame, asked: Asked) -> DataFrame:
    """Phase 2: of each list part the entries that reach the least threshold of any item."""

    def fetch(batches):
        for batch in batches:
            out = []
            for part in batch.to_pylist():
                least = asked.least.get(part["term"])
                if least is not None and part["top"] >= least:
                    reps, gains = unpacked(part)
                    n = int(np.searchsorted(-gains, -least, "right"))
                    out.append((part["term"], part["bucket"], part["reps"][: 8 * n], part["gains"][: 4 * n]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["term", "bucket", "reps", "gains"])

    return lists.select("term", "bucket", "top", "reps", "gains").mapInArrow(fetch, "term string, bucket long, reps binary, gains binary")


def added_up(parts: DataFrame, asked: Asked, k: int) -> DataFrame:
    """(item_id, rep, bucket, s, most): sums of what reaches each item's threshold, and the most a document can
    have, for the documents that may be among the item's first k as far as its bucket tells."""

    def merge(group: pa.Table) -> pa.Table:
        held = {p["term"]: unpacked(p) for p in group.to_pylist()}
        docs = np.unique(np.concatenate([reps for reps, _ in held.values()]))
        held = {t: (np.searchsorted(docs, reps), gains, -gains) for t, (reps, gains) in held.items()}
        out, bucket = [], group["bucket"][0].as_py()
        for item, (bound, lists) in asked.items.items():
            s, rest = np.zeros(len(docs), np.int64), np.full(len(docs), sum(x[3] for x in lists), np.int64)
            for term, qw, least, most in lists:
                if term in held:
                    at, gains, falling = held[term]
                    n = int(np.searchsorted(falling, -least, "right"))
                    s[at[:n]] += qw * gains[:n]
                    rest[at[:n]] -= most
            least = max(bound, int(np.partition(s, -k)[-k]) if len(s) >= k else 0)
            keep = np.flatnonzero((s > 0) & (s + rest >= least))
            out.append((item, docs[keep], np.full(len(keep), bucket), s[keep], s[keep] + rest[keep]))
        return asked.table(out, ["rep", "bucket", "s", "most"])

    return parts.groupBy("bucket").applyInArrow(merge, f"item_id {asked.sql}, rep long, bucket long, s long, most long")


def looked_up(lists: DataFrame, candidates: DataFrame, asked: Asked) -> DataFrame:
    """Phase 3: (item_id, rep, score) of the candidates (item_id, rep, bucket, s), with what their lists hold below the thresholds."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        held, by_doc = {p["term"]: p for p in left.to_pylist()}, {}
        ids, reps, sums = right["item_id"].to_pylist(), right["rep"].to_numpy(), right["s"].to_numpy()
        rows: dict = {}
        for k, item in enumerate(ids):
            rows.setdefault(item, []).append(k)
        out = []
        for item, at in rows.items():
            mine, score = reps[at], sums[at].copy()
            for term, qw, least, _ in asked.items[item][1]:
                if term in held:
                    if term not in by_doc:
                        docs, gains = unpacked(held[term])
                        by_doc[term] = docs[order := np.argsort(docs)], gains[order]
                    docs, gains = by_doc[term]
                    place = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
                    found = (docs[place] == mine) & (gains[place] < least)
                    score += np.where(found, qw * gains[place], 0)
            out.append((item, mine, score))
        return asked.table(out, ["rep", "score"])

    parts = lists.select("term", "bucket", "reps", "gains").join(candidates.select("bucket").distinct(), "bucket", "left_semi")
    return parts.groupBy("bucket").cogroup(candidates.groupBy("bucket")).applyInArrow(look, f"item_id {asked.sql}, rep long, score long")


def searched(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
             held_terms: int = HELD_TERMS, bucket: int = BUCKET, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    asked = stored(item_terms(items, item, item_text), "asked")
    vocabulary, held = asked.select("term").distinct(), None
    if vocabulary.limit(held_terms + 1).count() <= held_terms:
        held = {r["term"].encode() for r in vocabulary.collect()}
    raw = stored(entered(docs, key, text, held), "entered")
    total = raw.where("kind = 2").agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    documents, length = total["N"], max(total["L"], 1)

    rows = raw.where("kind = 0").select("term", "rep", "tf", "n", "copies")
    if held is None:
        rows = rows.join(vocabulary, "term", "left_semi")
    where = F.pmod(F.xxhash64("rep"), F.lit(max(1, -(-documents // bucket)))).cast("long")
    rows = rows.select("term", where.alias("bucket"), "rep", gain(F.col("tf"), F.col("n"), documents, length).alias("gain"), "copies")
    lists = stored(packed(rows), "postings")

    weight = F.floor(1000 * F.log((2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = lists.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top")).select("term", weight.alias("w"), "top")
    known = asked.join(weights, "term").select("item_id", "term", (F.col("q") * F.col("w")).alias("qw"), "top").where("qw * top > 0")
    asked_now = stored(known, "asked")
    discard(asked)

    # Phase 1, and the uniform thresholds, at least 1. ``most`` is what a list that has not shown a document may still add.
    sums = first_entries(lists, k).join(asked_now, "term").groupBy("item_id", "rep").agg(F.sum(F.col("qw") * F.col("gain")).alias("s"))
    lists_of = asked_now.groupBy("item_id").agg(F.count("*").alias("m")).join(kth(sums, k, "s", "bound"), "item_id")
    threshold = F.greatest(F.ceil(F.col("bound") / F.col("m")), F.lit(1)).cast("long")
    marked = asked_now.join(lists_of.withColumn("t", threshold), "item_id")
    most = F.least(F.col("qw") * F.col("top"), F.col("t") - 1).alias("most")
    marked = stored(marked.select("item_id", "bound", "term", "qw", _div(F.col("t") + F.col("qw") - 1, F.col("qw")).alias("least"), most), "marked")
    discard(asked_now)

    blocks = -(-marked.count() // pairs)
    kind, scores = to_arrow_type(marked.schema["item_id"].dataType), []
    for b in range(blocks):
        part = Asked(marked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect(), kind, marked.schema["item_id"].dataType.simpleString())
        hits = stored(added_up(fetched(lists, part), part, k), "hits")
        candidates = hits.join(kth(hits, k, "s", "bound"), "item_id").where("most >= bound").select("item_id", "rep", "bucket", "s")
        found = looked_up(lists, candidates, part)
        better = F.rank().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
        scores.append(stored(found.withColumn("_r", better).where(F.col("_r") <= k).drop("_r"), "scores"))
        discard(hits)
    discard(marked)
    discard(lists)

    # Copies: the first k ids of each representative.
    ids = raw.where("kind = 1").select("rep", "id")
    every = docs.sparkSession.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rep long, score long")
    for x in scores:
        every = every.union(x)
    by_id = [F.col("id").isNull(), "id"]
    ids = ids.join(every.select("rep").distinct(), "rep", "left_semi")
    copies = ids.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy(*by_id))).where(F.col("_r") <= k).drop("_r")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), *by_id))
    out = every.join(copies, "rep").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("item_id").alias(item), "rank", F.col("id").alias(key), "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return searched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
