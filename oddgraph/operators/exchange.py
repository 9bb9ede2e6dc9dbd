"""Rounds over a symmetric graph whose nodes lie in blocks, as arrays; a round is one exchange between the blocks.

A block holds its nodes, their entries and what is iterated for them. It sends another block one message a round, with
the values of those of its nodes that have an entry there, once however many entries there are. As the graph is symmetric,
both sides know these nodes from their own entries. What travels is (q, p, state, fixed): to block q from block p; a
block's own row, which alone has its fixed part, travels with the messages.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes of a block at most; of one at least, while there are fewer than ABOUT blocks.
ROWS, LEAST, ABOUT = 1 << 15, 1 << 10, 12
SCHEMA = "q int, p int, state binary, fixed binary"


def blocks(n: int) -> int:
    return max(1, -(-n // ROWS), min(ABOUT, -(-n // LEAST)))


def home(c: Column | str, count: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(count)).cast("int")


class Fixed:
    """Node ids in order; entries by row: row i's are at[i] to at[i + 1], col counts the block's own nodes first, then
    those of other blocks in the order of ``others``; ``routes``: places of the own nodes with an entry in each of these."""

    def __init__(self, me: int, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, there: np.ndarray, w: np.ndarray | None):
        self.ids, n = np.sort(ids), len(ids)
        row = np.searchsorted(self.ids, src)
        if len(src) and (self.ids[np.minimum(row, n - 1)] != src).any():
            raise ValueError("an entry of no node")
        order = np.argsort(row, kind="stable")
        row, dst, there = row[order], dst[order], there[order]
        self.w = None if w is None else w[order]
        self.at = np.searchsorted(row, np.arange(n + 1))
        away = there != me
        self.col = np.searchsorted(self.ids, dst).astype(np.int32)
        pairs, place = np.unique(np.stack([there[away].astype(np.int64), dst[away]]), axis=1, return_inverse=True)
        self.col[away] = n + place.ravel()
        self.others, self.counts = np.unique(pairs[0], return_counts=True)
        sent = np.unique(there[away] * np.int64(n) + row[away])
        self.routes = [x.astype(np.int32) for x in np.split(sent % max(n, 1), np.searchsorted(sent // max(n, 1), self.others[1:]))] if len(self.others) else []

    def sent(self, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for r, route in zip(self.others.tolist(), self.routes, strict=True):
            yield r, values[route].tobytes()

    def seen(self, values: np.ndarray, inbox: dict[int, bytes]) -> np.ndarray:
        """Values of the own nodes and of those of other blocks, as ``col`` counts them."""
        return np.concatenate([values, *(np.frombuffer(inbox[r], values.dtype).reshape(-1, *values.shape[1:]) for r in self.others.tolist())])

    def product(self, x: np.ndarray, piece: int) -> np.ndarray:
        """Rows of the operator times x, ``piece`` entries at a time."""
        out = np.zeros((len(self.ids), x.shape[1]))
        for a in range(0, len(self.col), piece):
            b = min(a + piece, len(self.col))
            first, last = np.searchsorted(self.at, [a, b - 1], "right") - 1
            rows = first + np.flatnonzero(np.diff(np.clip(self.at[first : last + 2], a, b)))
            out[rows] += np.add.reduceat(x[self.col[a:b]] * self.w[a:b, None], np.maximum(self.at[rows], a) - a, axis=0)
        return out


def row(q: int, p: int, state, fixed: bytes | None = None) -> pa.RecordBatch:
    held = state if isinstance(state, bytes) else pickle.dumps(state, 5)
    return pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([p], pa.int32()), pa.array([held], pa.binary()), pa.array([fixed], pa.binary())], ["q", "p", "state", "fixed"])


def packed(nodes: DataFrame, e: DataFrame, count: int, first: Callable) -> DataFrame:
    """Blocks of nodes(id, v) with the entries e(src, dst[, w]). first(block number, Fixed, ids in order of v, v) gives
    the block's state and its messages (block, bytes); v is any column."""
    weighted = "w" in e.columns
    kind = nodes.schema["v"].dataType
    mine = nodes.select(home("id", count).alias("q"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("int").alias("there"), F.lit(None).cast("double").alias("w"), "v")
    entries = e.select(home("src", count).alias("q"), "src", "dst", home("dst", count).alias("there"), (F.col("w").cast("double") if weighted else F.lit(None).cast("double")).alias("w"), F.lit(None).cast(kind).alias("v"))

    def pack(batches):
        if not (held := [b for b in batches if len(b)]):
            return
        group = pa.Table.from_batches(held)
        q = group["q"][0].as_py()
        own = pa.array(np.asarray(group["dst"].is_null()))
        x, y = group.filter(own), group.filter(pa.array(np.asarray(group["dst"].is_valid())))
        fixed = Fixed(q, x["src"].to_numpy(), y["src"].to_numpy(), y["dst"].to_numpy(), y["there"].to_numpy(), y["w"].to_numpy() if weighted else None)
        state, messages = first(q, fixed, x["src"].to_numpy(), x["v"])
        yield row(q, q, state, pickle.dumps(fixed, 5))
        for r, m in messages:
            yield row(r, q, m)

    return mine.union(entries).repartitionById(count, "q").mapInArrow(pack, SCHEMA)


def local(df: DataFrame, step: Callable) -> DataFrame:
    """step(block number, Fixed or None, state, inbox) gives the new state and messages; blocks are where their rows are."""

    def run(batches):
        own, inbox, q = None, {}, None
        for batch in batches:
            for r in batch.to_pylist():
                q = r["q"]
                if r["fixed"] is not None:
                    own = r
                else:
                    inbox[r["p"]] = r["state"]
        if q is None:
            return
        fixed, state = (pickle.loads(own["fixed"]), pickle.loads(own["state"])) if own else (None, None)
        state, messages = step(q, fixed, state, inbox)
        if own:
            yield row(q, q, state, own["fixed"])
        for r, m in messages:
            yield row(r, q, m)

    return df.mapInArrow(run, SCHEMA)


def exchanged(df: DataFrame, count: int, step: Callable) -> DataFrame:
    """As ``local``, after rows have gone to their blocks."""
    return local(df.repartitionById(count, "q"), step)


def over(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """The rows of record batches f(Fixed, state) of all blocks."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield f(pickle.loads(r["fixed"]), pickle.loads(r["state"]))

    return df.where("fixed is not null").mapInArrow(run, schema)
