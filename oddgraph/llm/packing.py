"""Packing by cutting-stock column generation.

Texts are encoded and cut into pieces of the sequence length and a rest. A rest is cut once more, at its
last multiple of a ``GRID``th of a sequence: a rest of over half a sequence rarely finds a partner that
fills the sequence, while multiples and their small remainders do, so that patterns waste next to nothing.
Only the histogram of piece lengths (under a hundred rows) reaches the driver. There a linear program over patterns (how
many pieces of each length share a sequence) is solved by a revised simplex that starts from patterns
of one length and whose columns are priced by an unbounded-knapsack dynamic program. Patterns are
rounded down; the pieces that rounding leaves, a few for each length, get patterns of their own by
first fit in decreasing length, and only what would pad those is a stream that is cut at the sequence length.
So nearly all sequences are patterns, and the padding is their slack. Patterns become ranges of ranks:
the pieces of one length are ranked over all documents, and a piece's rank gives its sequence and offset.

A piece's rank is its place among those of its length in the task that cut it, kept with the piece, plus
the counts of the tasks before; so no length, however frequent, is gathered or sorted.

Defined results: a null text is empty and packs its end id alone; repeated rows, equal and null ids are
packed each; very long texts are cut like others; an empty table gives an empty result; extra columns are
ignored. The simplex ends at a gap of ``GAP`` or after ``MOST_PIVOTS`` pivots, whose patterns are whole
packings too; ``waste`` tells how much of the sequences is padding and how much patterns fill.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddgraph.llm.common import stored, text_blocks
from oddgraph.llm.encode import encoder

LENGTH, END_ID, GRID = 1024, 0, 16
#: Patterns of the rounding rest that are filled to this share are kept.
FULL = 0.985
#: The simplex stops when no pattern gains more than GAP, or after so many pivots.
GAP, MOST_PIVOTS = 1e-3, 1500


def steps(lengths: np.ndarray, room: int) -> list[np.ndarray]:
    """What room is left of each room by each of the lengths that fit it."""
    return [c - lengths[: np.searchsorted(lengths, c, "right")] for c in range(room + 1)]


def priced(values: np.ndarray, lengths: np.ndarray, room: int, left: list[np.ndarray] | None = None) -> tuple[float, Counter]:
    """Unbounded knapsack: the pattern of the highest total value that fits the room."""
    best, last, left = np.zeros(room + 1), [-1] * (room + 1), left or steps(lengths, room)
    for c in range(1, room + 1):
        most = best[c - 1]
        if len(left[c]):
            got = best[left[c]]
            got += values[: len(got)]
            i = got.argmax()
            if got[i] > most + 1e-12:
                most, last[c] = got[i], i
        best[c] = most
    found, c = Counter(), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            found[int(last[c])] += 1
            c -= int(lengths[last[c]])
    return float(best[room]), found


def linear_program(lengths: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[Counter], np.ndarray]:
    """Patterns by index into ``lengths`` and how often each is used, in fractions, for all of the demand.

    Patterns of one length are the first basis, so every step is a feasible packing.
    """
    m, each = len(lengths), room // lengths
    basis = [Counter({i: int(n)}) for i, n in enumerate(each)]
    inverse, used, left = np.diag(1.0 / each), demand / each, steps(lengths, room)
    for _ in range(MOST_PIVOTS):
        value, pattern = priced(inverse.sum(axis=0), lengths, room, left)
        if value <= 1 + GAP:
            break
        column = np.zeros(m)
        column[list(pattern)] = list(pattern.values())
        along = inverse @ column
        ratio = np.where(along > 1e-9, used / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / along[out]
        rows = np.flatnonzero(np.abs(along) > 1e-12)
        inverse[rows] -= np.outer(along[rows], pivot)
        inverse[out] = pivot
        used = np.maximum(used - ratio[out] * along, 0)
        used[out], basis[out] = ratio[out], pattern
    return basis, used


def first_fit(left: dict[int, int], room: int) -> list[Counter]:
    """Sequences for the few pieces that rounding leaves, by first fit in decreasing length."""
    found: list[tuple[int, Counter]] = []
    for length in sorted(left, reverse=True):
        at = 0
        for _ in range(left[length]):
            while at < len(found) and found[at][0] < length:
                at += 1  # what this length does not fit is full for the next of its length too
            if at == len(found):
                found.append((room, Counter()))
            space, pattern = found[at]
            pattern[length] += 1
            found[at] = (space - length, pattern)
    return [p for _, p in found]


def patterns(histogram: dict[int, int], room: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """(pieces per length, times used), never more pieces than the histogram holds."""
    out = [({room: 1}, histogram[room])] if histogram.get(room) else []
    lengths = np.array(sorted(x for x in histogram if x < room and histogram[x]))
    if not len(lengths):
        return out
    left = np.array([histogram[int(x)] for x in lengths])
    found, used = linear_program(lengths, left.astype(float), room)
    for pattern, x in sorted(zip(found, used), key=lambda z: -z[1]):
        times = min(int(x + 1e-6), *(int(left[i]) // n for i, n in pattern.items()))
        if times > 0 and sum(int(lengths[i]) * n for i, n in pattern.items()) >= FULL * room:
            for i, n in pattern.items():
                left[i] -= times * n
            out.append(({int(lengths[i]): n for i, n in pattern.items()}, times))
    rest = Counter(tuple(sorted(p.items())) for p in first_fit({int(x): int(n) for x, n in zip(lengths, left) if n}, room))
    return out + [(dict(p), times) for p, times in rest.items() if sum(x * n for x, n in p) >= FULL * room]


def waste(histogram: dict[int, int], room: int = LENGTH) -> tuple[float, float]:
    """Shares of the sequences' places that are padding, and of the pieces' ids that lie in patterns."""
    plan, ids = Plan(histogram, room), sum(x * n for x, n in histogram.items())
    streamed = sum((n - plan.taken.get(x, 0)) * x for x, n in histogram.items())
    sequences = plan.first_stream + -(-streamed // room)
    return 1 - ids / (sequences * room), 1 - streamed / ids


class Plan:
    """Where the piece of a length and rank goes: pattern slots first, then the stream."""

    def __init__(self, histogram: dict[int, int], room: int = LENGTH):
        self.room = room
        taken, rows, sequence = Counter(), {}, 0
        for pattern, times in patterns(histogram, room):
            offset = 0
            for length, per in sorted(pattern.items(), reverse=True):
                rows.setdefault(length, []).append((taken[length], sequence, per, offset))
                taken[length] += per * times
                offset += per * length
            sequence += times
        self.rows = {k: np.array(v, np.int64) for k, v in rows.items()}
        self.taken, self.first_stream, self.base, at = dict(taken), sequence, {}, 0
        for length in sorted(histogram, reverse=True):
            self.base[length] = at
            at += (histogram[length] - taken[length]) * length

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(from, to, sequence, offset) of the one or two parts of the piece."""
        taken = self.taken.get(length, 0)
        if rank < taken:
            rows = self.rows[length]
            first, sequence, per, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1].tolist()
            k = rank - first
            return [(0, length, sequence + k // per, offset + k % per * length)]
        sequence, offset = divmod(self.base[length] + (rank - taken) * length, self.room)
        sequence += self.first_stream
        if offset + length <= self.room:
            return [(0, length, sequence, offset)]
        cut = self.room - offset
        return [(0, cut, sequence, offset), (cut, length, sequence + 1, 0)]


def cuts(n: int, room: int) -> list[int]:
    """Lengths of the pieces of n ids."""
    rest = n % room
    small = rest % max(1, room // GRID)
    return [room] * (n // room) + [x for x in (rest - small, small) if x]


def pieces(docs: DataFrame, path: str, kind: str = "byte", end_id: int = END_ID, room: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and cut it; written to the shared folder once. ``part`` and ``place``: the task
    that cut the piece, and the piece's place among those of its length there."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind_of_key = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "place"]

    def cut(batches):
        encode, end, part, counts = encoder(path, kind), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), Counter()
        for batch in text_blocks(batches, limit=1 << 22):
            at, start, length, tokens, ids, place = [], [], [], [], [], []
            for i, t in enumerate(batch["text"].to_pylist()):
                raw, a = encode(t) + end, 0
                for n in cuts(len(raw) // 4, room):
                    at.append(i)
                    start.append(a)
                    length.append(n)
                    tokens.append(len(raw) // 4)
                    ids.append(raw[4 * a : 4 * (a + n)])
                    place.append(counts[n])
                    counts[n] += 1
                    a += n
            long = lambda x: pa.array(x, pa.int64())
            crcs = [zlib.crc32(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch["key"].take(long(at)), long(start), long(length), long(crcs), long(tokens), pa.array(ids, pa.binary()), pa.array([part] * len(at), pa.int32()), long(place)], names)

    schema = f"doc_id {kind_of_key}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part int, place long"
    return stored(rows.mapInArrow(cut, schema), "pieces")


def packed(cut: DataFrame, room: int = LENGTH) -> DataFrame:
    """sequence_id, offset and ids of every piece."""
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under GRID + room / GRID rows
    plan = Plan(histogram, room)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            start, length, crc, ids, rank = (batch[c].to_pylist() for c in ("start", "length", "ids_crc32", "ids", "rank"))
            at, out = [], []
            for i, (n, r) in enumerate(zip(length, rank)):
                parts = plan.place(n, r)
                for a, b, sequence, offset in parts:
                    part = ids[i] if len(parts) == 1 else ids[i][4 * a : 4 * b]
                    at.append(i)
                    out.append((start[i] + a, b - a, crc[i] if len(parts) == 1 else zlib.crc32(part), part, sequence, offset))
            at, cols = pa.array(at, pa.int64()), list(zip(*out)) or [()] * 6
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(at), long(cols[0]), long(cols[1]), long(cols[2]), batch["doc_tokens"].take(at), pa.array(cols[3], pa.binary()), long(cols[4]), long(cols[5])], names
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long")


def op8_pack_sequences(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))).drop("ids")
