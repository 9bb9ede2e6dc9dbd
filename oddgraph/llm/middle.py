"""Fill-in-the-middle transformation by a table-driven byte automaton.

The texts of a block are one stream of symbol classes (white space, ``<``, a sentinel's letter, ``>``,
any other first byte of a sign, a UTF-8 continuation byte, end of text). The table gives for each state
and class the next state and what the transition emits: the start of a unit, the start of a sign, the
end of a sentinel. A state follows from the last two symbols, so the stream runs in lanes side by side,
each begun two symbols early: one scan of vector steps. What each lane emits is counted; a second pass
finds a cut by the lanes' counts and looks at one lane only.

A unit is white space with the word after it, or white space at the end of the text. Prefix, middle
and suffix end at units, drawn by a hash of seed and id, so every run gives the same output.

Defined results: null and empty texts are plain with no units; a text that holds a sentinel stays plain;
a null id draws as the empty id; repeated rows give repeated results; very long texts are read in one
piece of a few bytes a byte; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddgraph.llm.common import text_blocks

SEED, RATE, SPM_SHARE = 42, 50, 80
LANE, WARM = 256, 2
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Symbol classes.
BLANK, OPEN, LETTER, CLOSE, FIRST, REST, END = range(7)
# States: after the end of a text, after white space, within a word, after ``<``, after ``<`` and a sentinel's letter.
START, WHITE, WORD, OPENED, NAMED = range(5)
UNIT, SIGN, SENTINEL = 1, 2, 4


def _classes() -> np.ndarray:
    out = np.full(256, FIRST, np.uint8)
    out[list(b" \t\n\x0b\x0c\r")] = BLANK
    out[list(b"PSM")] = LETTER
    out[ord("<")], out[ord(">")] = OPEN, CLOSE
    out[0x80:0xC0] = REST
    return out


def _table() -> np.ndarray:
    """Next state * 8 + emitted bits, for state * 7 + class."""
    out = np.zeros((5, 7), np.uint8)
    for state in range(5):
        for symbol in range(7):
            nxt = {BLANK: WHITE, OPEN: OPENED, END: START}.get(symbol, WORD)
            if state == OPENED and symbol == LETTER:
                nxt = NAMED
            emitted = 0 if symbol in (REST, END) else SIGN
            if symbol != END and (state == START or symbol == BLANK and state != WHITE):
                emitted |= UNIT
            if state == NAMED and symbol == CLOSE:
                emitted |= SENTINEL
            out[state, symbol] = nxt * 8 + emitted
    return out.ravel()


_CLASSES, _TABLE = _classes(), _table()


class Scan:
    """One scan of texts that lie one after another in ``raw``, ends[i] to ends[i + 1]."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, lane: int = LANE):
        self.lane = lane
        #: Text i is starts[i] to stops[i] of the stream.
        self.starts, self.stops = ends[:-1] + np.arange(len(ends) - 1), ends[1:] + np.arange(len(ends) - 1)
        stream = np.insert(_CLASSES[raw], ends[1:], END)
        lanes = len(stream) // lane + 1
        stream = np.concatenate([np.full(WARM, END, np.uint8), stream, np.full(lanes * lane - len(stream), END, np.uint8)])
        steps = np.empty((lane + WARM, lanes), np.uint8)
        for k in range(WARM):
            steps[k] = stream[k::lane][:lanes]
        steps[WARM:] = stream[WARM:].reshape(lanes, lane).T
        state = np.zeros(lanes, np.uint8)
        for symbols in steps:
            np.add(state, symbols, out=symbols)
            np.take(_TABLE, symbols, out=symbols)
            state = (symbols >> 3) * np.uint8(7)
        self.out = np.ascontiguousarray(steps[WARM:].T).ravel()
        self.counts = {}
        for bit in (UNIT, SIGN, SENTINEL):
            of_lane = np.count_nonzero(steps[WARM:] & np.uint8(bit), axis=0)
            self.counts[bit] = np.concatenate([[0], np.cumsum(of_lane)])

    def before(self, bit: int, at: int) -> int:
        """Transitions that emit ``bit`` before a place of the stream."""
        k = at // self.lane
        return int(self.counts[bit][k]) + int(np.count_nonzero(self.out[k * self.lane : at] & bit))

    def find(self, bit: int, n: int) -> int:
        """Place of the n-th (from 0) transition that emits ``bit``."""
        k = int(np.searchsorted(self.counts[bit], n, "right")) - 1
        inside = np.flatnonzero(self.out[k * self.lane : (k + 1) * self.lane] & bit)
        return k * self.lane + int(inside[n - int(self.counts[bit][k])])


def block_scan(column: pa.Array) -> tuple[bytes, np.ndarray, Scan]:
    """The bytes of a column of texts (null: empty), where each begins, and their scan."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0], Scan(raw, ends - ends[0])


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """Per row: key, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    ``rate`` percent of the texts are cut, ``spm_share`` percent of those give suffix first.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(key).alias("key"), F.substring(drawn, 1, 32).alias("drawn"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches):
        for block in text_blocks(batches):
            raw, ends, scan = block_scan(block["text"])
            out = []
            for i, drawn in enumerate(block["drawn"].to_pylist()):
                h = [int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24)]
                a, b, whole = scan.starts[i], scan.stops[i], raw[ends[i] : ends[i + 1]].tobytes()
                first = scan.before(UNIT, a)
                n = scan.before(UNIT, b) - first
                if not whole or h[2] % 100 >= rate or scan.before(SENTINEL, b) > scan.before(SENTINEL, a):
                    out.append((n, "plain", None, None, whole))
                    continue
                cuts = [b if u == n else scan.find(UNIT, first + u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
                signs = [scan.before(SIGN, x) for x in (a, *cuts)]
                prefix, middle, suffix = whole[: cuts[0] - a], whole[cuts[0] - a : cuts[1] - a], whole[cuts[1] - a :]
                spm = h[3] % 100 < spm_share
                made = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if spm else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
                out.append((n, "spm" if spm else "psm", signs[1] - signs[0], signs[2] - signs[1], made))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays([block["key"], *cols[:4], cols[4].cast(pa.string())], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    found = rows.mapInArrow(cut, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("key", key)


def restored(form: Column, output: Column) -> Column:
    """The text again, from output and form alone. A cut text holds no sentinel of its own."""
    parts = F.split(output, "<[PSM]>", -1)
    whole = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, order in whole.items():
        out = out.when(form == name, F.concat(*[F.get(parts, F.lit(k)) for k in order]))
    return out


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
