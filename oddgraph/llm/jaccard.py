"""Exact n-gram Jaccard join as a metric-space join.

Jaccard distance is a metric on shingle sets. Texts of equal sets are one node from the start (its id
is the hash of the set), so copies cost one row each.

First-level pivots are single shingles: against {s} a set of n shingles has distance 1 - 1/n if it
holds s, else 1, so a node lies in the Voronoi regions of its own shingles, and two nodes within the
radius share nearly all of their regions. (Pivots that are documents cannot make the first level:
documents without a common shingle are all at distance 1, and the window would copy each everywhere.)
The pivots are the shingles of the lowest ``POOL`` * (1 - t) of the hash space, a choice that every
node makes alike. A region of at most ``LEAF`` nodes proposes its pairs. Of two linked sets x, y with
overlap o >= t/(1+t) (|x|+|y|), at most |x| - o shingles of x are missing from y, so they share at
least c(x) - (|x| - o) small regions, where c counts x's pivots in small regions; pairs that share
fewer are no links. A node whose c exceeds what any partner can lack, |x| - ceil(t |x|), is closed: all
its links have been proposed. Open nodes (texts made of very common passages, large groups of near
copies, tiny sets) are joined again among themselves over all of their shingles.

What is still open then lies in large regions: a node keeps those of its rarest shingles, as many as a
partner cannot lack. These are joined recursively by pivots that are documents. One pivot of a region, its
centre, is a member of its largest connected part: all distances to it are computed exactly. Members
within the radius (its ball) are linked to it, so connected among themselves. A link between the ball, or
the centre's part, and the shell outside needs |d(x,p) - d(y,p)| <= r, so of these only the rim, at least
the nearest shell distance - r from the centre, stays with the shell. Pivots of the other parts are
compared with the members that they may link with though they share no small region; all other pairs were
settled by their small regions. A region is done when all of its members are connected. Level after level
draws ``GROWTH`` times as many pivots from the other parts, until no region is left; nothing is capped.

Verification is exact, on whole sets; pairs that links verified before connect already are skipped,
because the result is components, not pairs. Defined results: null or empty texts have empty sets, which
link with nothing (component_id is their own id); repeated rows, rows of equal ids with differing
texts and rows of null id are nodes by their text like any other, null never being the smallest id
unless a component has no other; very long texts are read in pieces; an empty table gives an empty
result; extra columns are ignored. Keys are integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.llm.common import discard, grams, mix, signed, stored, text_blocks, word_hashes
from oddgraph.llm.components import components

SHINGLE, NUM, DEN = 4, 85, 100
POOL, LEAF, FIRST, GROWTH = 1.7, 24, 4, 64
#: Entries of a chunk of one task, and of a slice of the hash space (its share of all chunks).
CHUNK, SLICE = 1 << 19, 1 << 18


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one shingle."""
    hashed, at = word_hashes(column, lower=True)
    whole, at, out = mix(grams(hashed, size) + np.uint64(size)), at.tolist(), []
    for a, b in zip(at, at[1:]):
        if b - a >= size:
            s = whole[a : b - size + 1].copy()
            s.sort()
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(mix(grams(hashed[a:b], b - a) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    n = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return n - (1 << 64) if n >> 63 else n


def size_class(n: int, num: int, den: int) -> int:
    """Sets within the radius are of the same or of neighbouring classes."""
    return int(math.log(max(n, 1)) / math.log(1.02 * den / num))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


class Chunk:
    """Pool entries (shingle, node, size class) of many nodes of one task, dealt to slices at its end.

    A shingle of more than ``leaf`` nodes of the chunk is large already: one marker stands for its
    entries, which are counted with their nodes here, so a shingle that a third of all rows hold
    costs a few entries a chunk.
    """

    def __init__(self, slices: int, leaf: int):
        self.slices, self.leaf = slices, leaf
        self.clear()

    def clear(self) -> None:
        self.shingles, self.sids, self.classes, self.counts, self.total = [], [], [], [], 0

    def add(self, sid: int, size_of: int, pool: np.ndarray) -> None:
        self.sids.append(sid), self.classes.append(size_of), self.counts.append(len(pool)), self.shingles.append(pool)
        self.total += len(pool)

    def dealt(self):
        """(large entries of each node added, their shingles by entry, their nodes), then a row for each slice with anything in it."""
        if not self.total:
            return np.zeros(len(self.sids), np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), []
        shingles = np.concatenate(self.shingles)
        node = np.repeat(np.arange(len(self.sids)), self.counts)
        order = np.argsort(shingles, kind="stable")
        starts, lengths = _runs(shingles[order])
        crowd = np.zeros(len(shingles), bool)
        crowd[order] = np.repeat(lengths > self.leaf, lengths)
        marks = shingles[order][starts[lengths > self.leaf]]
        sids, classes = np.array(self.sids, np.int64), np.array(self.classes, np.uint8)
        part = lambda x: ((x >> np.uint64(32)) * np.uint64(self.slices) >> np.uint64(32)).astype(np.int64)
        rest, owner = shingles[~crowd], node[~crowd]
        where = part(rest)
        order = np.argsort(where, kind="stable")  # keeps a node's entries together: its id compresses
        rest, owner = rest[order], owner[order]
        cuts, mark_cuts = np.searchsorted(where[order], np.arange(self.slices + 1)), np.searchsorted(part(marks), np.arange(self.slices + 1))
        rows = []
        for k in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(mark_cuts) > 0)).tolist():
            a, b = cuts[k], cuts[k + 1]
            rows.append((k, rest[a:b].tobytes(), sids[owner[a:b]].tobytes(), classes[owner[a:b]].tobytes(), marks[mark_cuts[k] : mark_cuts[k + 1]].tobytes()))
        return np.bincount(node[crowd], minlength=len(sids)), shingles[crowd], sids[node[crowd]], rows


_SLICE = "slice int, shingles binary, sids binary, classes binary, marks binary"
_SLICE_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _proposed(slices: DataFrame, leaf: int, keep_large: bool) -> DataFrame:
    """Of each slice: pairs (a, b, k: shared small regions) whose size classes allow a link, and (a,
    null, k: its large regions); with keep_large (a, null, 1, region) for each large region instead."""

    def join(group: pa.Table) -> pa.Table:
        get = lambda c, kind: np.frombuffer(b"".join(x for x in group[c].to_pylist()), kind)
        shingles, sids, classes, marks = get("shingles", "<u8"), get("sids", "<i8"), get("classes", np.uint8), get("marks", "<u8")
        order = np.lexsort((sids, shingles))
        shingles, sids, classes = shingles[order], sids[order], classes[order]
        if len(shingles):  # a set that several tasks met
            fresh = np.append(True, (shingles[1:] != shingles[:-1]) | (sids[1:] != sids[:-1]))
            shingles, sids, classes = shingles[fresh], sids[fresh], classes[fresh]
        starts, lengths = _runs(shingles)
        large = (lengths > leaf) | np.isin(shingles[starts], marks)
        entries = np.repeat(large, lengths)
        first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in np.unique(lengths[~large & (lengths > 1)]).tolist():
            at = starts[~large & (lengths == m)]
            i, j = np.triu_indices(m, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            near = np.abs(classes[x].astype(np.int16) - classes[y]) <= 1
            first.append(sids[x[near]]), second.append(sids[y[near]])
        a, b = np.concatenate(first), np.concatenate(second)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
        k = np.diff(np.append(at, len(a)))
        if keep_large:
            who, counts, region = sids[entries], np.ones(int(entries.sum()), np.int64), signed(shingles[entries])
        else:
            who, counts = np.unique(sids[entries], return_counts=True)
            region = np.zeros(len(who), np.int64)
        none = pa.nulls(len(who), pa.int64())
        return pa.table({
            "a": pa.array(np.concatenate([a[at], who])), "b": pa.concat_arrays([pa.array(b[at]), none]),
            "k": pa.array(np.concatenate([k, counts]).astype(np.int64)), "region": pa.array(np.concatenate([np.zeros(len(at), np.int64), region])),
        })

    return slices.groupBy("slice").applyInArrow(join, "a long, b long, k long, region long")


def _candidates(proposed: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that share as many small regions as a link must. nodes(sid, n, c)."""
    counted = proposed.where("b is not null").groupBy("a", "b").agg(F.sum("k").alias("k"))
    na, nb = (nodes.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
    both = counted.join(na, "a").join(nb, "b")
    overlap = F.ceil(num * (F.col("na") + F.col("nb")) / (num + den) - 1e-9)
    need = F.greatest(F.lit(1), F.col("ca") - F.col("na") + overlap, F.col("cb") - F.col("nb") + overlap)
    alike = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    return both.where(alike & (F.col("k") >= need)).select("a", "b")


def _open(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Nodes with so few small regions that a link may share none of them."""
    return nodes.where((F.col("n") > 0) & (F.col("c") <= F.col("n") - F.ceil(num * F.col("n") / den - 1e-9)))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) with their exact distance: a, b, d, linked. sets(sid, shingles)."""
    sa, sb = (sets.select(F.col("sid").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(sa, "a").join(sb, "b")

    def measure(batches):
        for batch in batches:
            d, linked, last, one = [], [], None, None
            for key, ta, tb in zip(batch["b"].to_pylist(), batch["set_a"], batch["set_b"]):
                if key != last:
                    last, one = key, np.frombuffer(tb.as_buffer(), "<u8")
                other = np.frombuffer(ta.as_buffer(), "<u8")
                both = np.concatenate([one, other])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                union = len(both) - same
                d.append(1 - same / union)
                linked.append(den * same >= num * union)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "d", "linked"])

    return stored(both.mapInArrow(measure, "a long, b long, d double, linked boolean"), "verified")


def _links_of(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links that connect what the pairs' links connect: each node with its first partner, then only
    pairs whose ends are not connected by those."""
    star = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
    links = _verify(star, sets, num, den).where("linked").select("a", "b")
    known = components(links)
    la, lb = (known.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    rest = pairs.join(star, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left")
    rest = stored(rest.where(F.coalesce(F.col("la") != F.col("lb"), F.lit(True))).select("a", "b"), "rest")
    return stored(links.union(_verify(rest, sets, num, den).where("linked").select("a", "b")), "links")


def _by_documents(regions: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Components (node, label) of the links within the large regions (region, sid, n, c), found by pivot
    documents, and of ``links``, known before. The first pivots are those of the fewest shingles of their
    own (c): of a group of edited copies that is the text the others were made from, which links them."""
    radius, level, known = 1 - num / den, 0, components(links)
    while True:
        named = regions.join(known.withColumnRenamed("node", "sid"), "sid", "left").select("region", "sid", "n", "c", F.coalesce("label", "sid").alias("label"))
        # Pivots: about FIRST * GROWTH**level members of each region, none of its largest connected part, by a draw
        # that is the same in all regions. When all others have been pivots, one part is left.
        parts = named.groupBy("region", "label").agg(F.count("*").alias("m"))
        live = parts.groupBy("region").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        named = stored(named.join(live.select("region", "m", F.col("top.label").alias("top")), "region"), "regions")
        if named.isEmpty():
            return known
        draw = F.xxhash64("sid", F.lit(level))
        others = named.where("label <> top")
        firsts = others.groupBy("region").agg(F.min(F.struct("c", draw.alias("h"), "sid")).alias("p")).select("region", F.col("p.sid").alias("first"))
        share = (draw.cast("double") / 2.0**64 + 0.5) * F.col("m")
        chosen = others.join(firsts, "region").where((F.col("sid") == F.col("first")) | (share < FIRST * GROWTH**level)).select("region", "sid", "n", "c", "label")
        centres = named.where("label = top").groupBy("region").agg(F.min(F.struct("c", draw.alias("h"), "sid", "n", "label")).alias("p")).select("region", "p.sid", "p.n", "p.c", "p.label")
        pivots = chosen.withColumn("centre", F.lit(False)).union(centres.withColumn("centre", F.lit(True)))
        pivots = stored(pivots.select("region", F.col("sid").alias("pivot"), F.col("n").alias("np"), F.col("c").alias("cp"), F.col("label").alias("lp"), "centre"), "pivots")
        # A centre is measured against all members. A chosen pivot needs only those of other parts that it may link
        # with though they share no small region: pairs that do share one, or would have to, are settled.
        alike = den * F.least("n", "np") >= num * F.greatest("n", "np")
        overlap = F.ceil(num * (F.col("n") + F.col("np")) / (num + den) - 1e-9)
        possible = alike & (F.col("label") != F.col("lp")) & (overlap <= F.least(F.col("n") - F.col("c"), F.col("np") - F.col("cp")))
        placed = named.join(pivots, "region").where(F.when(F.col("centre"), F.col("sid") != F.col("pivot")).otherwise(possible))
        placed = stored(placed.select("region", "sid", "n", "label", "pivot", "np", "lp", "centre"), "placed")
        pairs = placed.where(alike).select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()
        measured = _verify(pairs, sets, num, den)
        fresh = measured.where("linked").join(known.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        fresh = stored(fresh.where(F.coalesce(F.col("la") != F.col("lb"), F.lit(True))).select("a", "b"), "fresh")
        if not fresh.isEmpty():
            links = stored(links.union(fresh), "links")
            known = components(links)
        both = placed.where("centre").withColumns({"a": F.least("sid", "pivot"), "b": F.greatest("sid", "pivot")}).join(measured, ["a", "b"], "left")
        apart = F.coalesce("d", 1 - F.least("n", "np") / F.greatest("n", "np"))
        both = both.select("region", "sid", "pivot", apart.alias("d"), F.col("d").isNotNull().alias("exact"), F.coalesce("linked", F.lit(False)).alias("linked"), (F.col("label") == F.col("lp")).alias("same"))
        both = stored(both, "distances")
        # A link between a member near a centre, or of its part, and one that is neither needs distances to the centre
        # that differ by the radius at most: of the near ones only the rim stays. Pivots are done.
        shell = both.where("not linked and not same").groupBy("region", "pivot").agg(F.min("d").alias("nearest"))
        inner = both.where("exact and (linked or same)").join(shell, ["region", "pivot"], "left").where(F.col("nearest").isNull() | (F.col("d") < F.col("nearest") - radius - 1e-9))
        done = pivots.select("region", F.col("pivot").alias("sid"))
        gone = inner.select("region", "sid").union(done).distinct()
        before, regions = regions, stored(named.select("region", "sid", "n", "c").join(gone, ["region", "sid"], "left_anti"), "left")
        for x in (before, named, pivots, placed, measured, fresh, both):
            discard(x)
        level += 1


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN, leaf: int = LEAF, pool: float = POOL) -> DataFrame:
    """Per row: key, text_hash, n_shingles, set_id, component_id, and whether the row is its component's
    first by (key, text_hash), ``keeper`` (true for rows without words)."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    letters = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, pool * (1 - num / den))
    below, slices = np.uint64(min(2**64 - 1, int(share * 2**64))), int((64 + letters / 6 * share / SLICE) / share)

    def enter(batches):
        """A digest row for each text, then the rows of slices."""
        chunk, keys, hashes, digests, seen = Chunk(slices, leaf), [], [], [], set()
        names = ["key", "text_hash", "sid", "n", "c", "slice", "shingles", "sids", "classes", "marks"]

        def flush():
            large, _, _, dealt = chunk.dealt()
            sid, n, c, at = (np.array(x, np.int64) for x in zip(*digests))
            c[at >= 0] -= large[at[at >= 0]]
            k = len(digests)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.concat_arrays(hashes), pa.array(sid), pa.array(n), pa.array(c), *(pa.nulls(k, t) for t in _SLICE_TYPES)], names)
            for a in range(0, len(dealt), 64):
                some = list(zip(*dealt[a : a + 64]))
                none = [pa.nulls(len(some[0]), pa.int64())] * 5
                yield pa.RecordBatch.from_arrays([*none, *(pa.array(x, t) for x, t in zip(some, _SLICE_TYPES))], names)
            chunk.clear(), keys.clear(), hashes.clear(), digests.clear(), seen.clear()

        for block in text_blocks(batches):
            keys.append(block["key"]), hashes.append(block["text_hash"])
            for s in shingle_sets(block["text"], size):
                sid, c, at = set_id(s), int(np.searchsorted(s, below)), -1
                if len(s) and sid not in seen:
                    seen.add(sid)
                    at = len(chunk.sids)
                    chunk.add(sid, size_class(len(s), num, den), s[:c])
                digests.append((sid, len(s), c, at))
            if chunk.total >= CHUNK or len(digests) >= CHUNK:
                yield from flush()
        if digests:
            yield from flush()

    schema = f"key long, text_hash long, sid long, n long, c long, {_SLICE}"
    entered = stored(rows.mapInArrow(enter, schema), "entered")
    digests = entered.where("slice is null").select("key", "text_hash", "sid", "n", "c")
    # A copy's c is one met again in its chunk and not lessened; the least is that of the first.
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash"))
    nodes = stored(digests.groupBy("sid").agg(first.alias("first"), F.first("n").alias("n"), F.min("c").alias("c")), "nodes")
    proposed = stored(_proposed(entered.where("slice is not null").select("slice", "shingles", "sids", "classes", "marks"), leaf, False), "proposed")
    digests = stored(digests.drop("c"), "digests")
    discard(entered)
    large = proposed.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("k").alias("large"))
    counted = stored(nodes.join(large, "sid", "left").select("sid", "first", "n", (F.col("c") - F.coalesce("large", F.lit(0))).alias("c")), "counted")
    pairs = stored(_candidates(proposed, counted, num, den), "pairs")
    discard(proposed)
    unsure = _open(counted, num, den).select("sid", F.lit(1).alias("open"))
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).select("sid", F.lit(0).alias("open"))
    wanted = unsure.union(ends).groupBy("sid").agg(F.max("open").alias("open")).join(nodes, "sid").select("sid", "open", F.coalesce("first.key", F.lit(0)).alias("k0"), "first.text_hash")

    def sets_of(batches):
        for block in text_blocks(batches):
            found = [s.tobytes() for s in shingle_sets(block["text"], size)]
            yield pa.RecordBatch.from_arrays([block["sid"], block["open"], pa.array(found, pa.binary())], ["sid", "open", "shingles"])

    # The text hash tells the text; the key spreads copies.
    texts = rows.select(F.coalesce("key", F.lit(0)).alias("k0"), "text_hash", "text").join(wanted, ["k0", "text_hash"])
    sets = stored(texts.dropDuplicates(["k0", "text_hash"]).select("sid", "open", "text").mapInArrow(sets_of, "sid long, open int, shingles binary"), "sets", compression="none")

    # Open nodes among themselves, over all their shingles.
    entries = sets.where("open = 1").agg(F.sum(F.octet_length("shingles") / 8)).first()[0] or 0
    slices_open = 64 + int(entries / SLICE)

    def enter_open(batches):
        chunk, names = Chunk(slices_open, leaf), ["sid", "region", "slice", "shingles", "sids", "classes", "marks"]

        def flush():
            _, regions, sids, dealt = chunk.dealt()
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(signed(regions)), *(pa.nulls(len(sids), t) for t in _SLICE_TYPES)], names)
            for a in range(0, len(dealt), 64):
                some = list(zip(*dealt[a : a + 64]))
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some[0]), pa.int64())] * 2, *(pa.array(x, t) for x, t in zip(some, _SLICE_TYPES))], names)
            chunk.clear()

        for batch in batches:
            for sid, raw in zip(batch["sid"].to_pylist(), batch["shingles"]):
                s = np.frombuffer(raw.as_buffer(), "<u8")
                chunk.add(sid, size_class(len(s), num, den), s)
                if chunk.total >= CHUNK:
                    yield from flush()
        yield from flush()

    opened = stored(sets.where("open = 1").select("sid", "shingles").mapInArrow(enter_open, f"sid long, region long, {_SLICE}"), "opened")
    proposed = stored(_proposed(opened.where("slice is not null").select("slice", "shingles", "sids", "classes", "marks"), leaf, True), "proposed")
    crowded = opened.where("slice is null").select("region", "sid").union(proposed.where("b is null").select("region", F.col("a").alias("sid"))).distinct()
    crowded = stored(crowded, "crowded")
    discard(opened)
    large = crowded.groupBy("sid").agg(F.count("*").alias("large"))
    again = unsure.select("sid").join(counted.select("sid", "n"), "sid").join(large, "sid", "left")
    again = stored(again.select("sid", "n", (F.col("n") - F.coalesce("large", F.lit(0))).alias("c")), "again")
    pairs = stored(pairs.union(_candidates(proposed, again, num, den)).distinct(), "pairs")
    links = _links_of(pairs, sets, num, den)

    # Large regions of what is still open: of a node's rarest shingles, as many as a partner cannot lack.
    still = _open(again, num, den)
    crowds = crowded.groupBy("region").agg(F.count("*").alias("m"))
    mine = crowded.join(still, "sid").join(crowds, "region").groupBy("sid", "n", "c").agg(F.array_sort(F.collect_list(F.struct("m", "region"))).alias("all"))
    lack = (F.col("n") - F.ceil(num * F.col("n") / den - 1e-9) + 1 - F.col("c")).cast("int")
    regions = stored(mine.select("sid", "n", "c", F.explode(F.slice("all", F.lit(1), lack)).alias("x")).select(F.col("x.region").alias("region"), "sid", "n", "c"), "regions")
    parts = _by_documents(regions, links, sets, num, den)
    labels = nodes.join(parts, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("label", "sid").alias("label"))
    firsts = labels.groupBy("label").agg(F.min("first").alias("keeps"))
    labels = stored(labels.join(firsts, "label").select("sid", "keeps"), "labels")
    empty = F.col("n") == 0
    return digests.join(labels, "sid").select(
        F.col("key").alias(key), "text_hash", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), F.when(empty, F.col("key")).otherwise(F.col("keeps.key")).alias("component_id"),
        (empty | (F.col("key").eqNullSafe(F.col("keeps.key")) & (F.col("text_hash") == F.col("keeps.text_hash")))).alias("keeper"),
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each group stays, the first by (id, hash of the text), nulls last; documents without
    words stay, each once. All columns stay as they are, whatever their names. Rows equal in id and text
    are one document, of which one row stays. An empty table gives an empty one."""
    k, h = "__oddgraph_key", "__oddgraph_text"
    found = joined(docs.select(key, text), key, text, size, num, den)
    kept = found.where("keeper").select(F.xxhash64(key).alias(k), F.col("text_hash").alias(h)).distinct()
    marked = docs.withColumns({k: F.xxhash64(F.col(key).cast("long")), h: F.xxhash64(text)})
    return marked.join(kept, [k, h], "left_semi").dropDuplicates([k, h]).drop(k, h)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
