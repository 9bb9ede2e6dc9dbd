"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, the ``://`` of a
scheme and identifier cues ("IBAN", "SSN", "account" and their like). From an anchor a local parser
expands to both sides over the signs its kind allows, so each is linear in what it reads, and validates
what it found: octets, check digits, counts of digits, bounds.

Base kinds are email, ip, card and phone, found left to right without overlap within a kind; a failing
candidate is dropped and not tried again shorter. Added kinds need more evidence than a form, so that
clean texts stay clean: ``url`` is a web address that carries a user name; ``iban`` passes its check
digits; ``ssn`` and ``account`` follow their cue.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; rows are
judged one by one, so repeated rows and null ids are results like any other; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddgraph.llm.common import text_blocks

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "ssn", "account")
KINDS = BASE + ADDED

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_LABEL = _LETTERS | _DIGITS | frozenset("-")
_CALL = _DIGITS | frozenset(" ().-")
# Schemes of addresses, cues before an identifier.
SCHEMES = ("http", "https", "ftp", "sftp")
CUES = {"iban": ("iban",), "ssn": ("ssn", "social security"), "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte")}
#: Signs that may stand between a cue and its identifier: a filler word and punctuation.
_FILLER = re.compile(r"(?: ?(?:number|no|nr|num|code))?(?:[ .:#=]{1,4})", re.IGNORECASE)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(x: str) -> bool:
    """Check digits: the rearranged number, letters as 10 to 35, is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed signs from a place on."""
    end = len(text)
    while at < end and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, least: int) -> tuple[int, Span | None]:
    """Around an at-sign: the local part to the left, not before ``least``, and at least two labels to the right."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    end = run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return least, None
    labels = 1
    while end < len(text) and text[end] == "." and (after := run(text, end + 1, _LABEL)) > end + 1:
        labels, end = labels + 1, after
    return (end, (start, end, "email")) if labels > 1 else (least, None)


def ips_at(text: str, at: int) -> tuple[int, list[Span]]:
    """From the first digit of a chain of numbers joined by single points: each four numbers are a candidate."""
    parts, end = [], at
    while (after := run(text, end, _DIGITS)) > end:
        parts.append((end, after))
        end = after
        if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS):
            break
        end += 1
    found = []
    for k in range(0, len(parts) - 3, 4):
        octets = [text[a:b].lstrip("0") for a, b in parts[k : k + 4]]
        if all(len(o) <= 3 and int(o or "0") <= 255 for o in octets):
            found.append((parts[k][0], parts[k + 3][1], "ip"))
    return parts[-1][1], found


def card_at(text: str, at: int) -> tuple[int, Span | None]:
    """From the first digit of a chain of digits with at most one space or hyphen between two."""
    end, digits = at + 1, [text[at]]
    while end < len(text):
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
        digits.append(text[end - 1])
    return end, (at, end, "card") if 12 <= len(digits) <= 19 and luhn("".join(digits)) else None


def phone_at(text: str, at: int) -> tuple[int, Span | None]:
    """From a plus sign: a digit, signs of a number, ending in a digit."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return at, None
    end = run(text, at + 2, _CALL)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4:
        return at, None
    digits = sum(c in _DIGITS for c in text[at:end])
    return end, (at, end, "phone") if 9 <= digits <= 15 else None


def url_at(text: str, at: int) -> Span | None:
    """Around ``://``: a known scheme, a user name with or without a password, a host."""
    start = at
    while start > 0 and at - start < 6 and text[start - 1] in _LETTERS:
        start -= 1
    if text[start:at].lower() not in SCHEMES:
        return None
    end, mark, limit = at + 3, -1, len(text)
    while end < limit and text[end] not in " \t\n\x0b\x0c\r/?#\"'<>":
        if text[end] == "@":
            mark = end
        end += 1
    while end > mark + 1 and text[end - 1] in ".,;:)":
        end -= 1
    return (start, end, "url") if mark > at + 3 and end > mark + 1 else None


def cued(text: str, at: int) -> int:
    """Where an identifier may begin after a cue that ends at a place, or -1."""
    found = _FILLER.match(text, at)
    return found.end() if found else -1


def iban_at(text: str, at: int) -> Span | None:
    """Two capitals, two digits, 11 to 30 capitals or digits in groups joined by single spaces; check digits."""
    if not (text[at : at + 2].isascii() and text[at : at + 2].isalpha() and text[at : at + 2].isupper() and text[at + 2 : at + 4].isascii() and text[at + 2 : at + 4].isdigit()):
        return None
    best, signs, end = None, [], at
    while end < len(text) and len(signs) < 34:
        c = text[end]
        if c in _DIGITS or "A" <= c <= "Z":
            signs.append(c)
        elif c != " " or text[end - 1] == " ":
            break
        end += 1
        closed = end == len(text) or not (text[end].isalnum() or text[end] == "_")
        if c != " " and closed and len(signs) >= 15 and iban_valid("".join(signs)):
            best = (at, end, "iban")
    return best


_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([- ])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z_-])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9A-Za-z_-])")


def ssn_at(text: str, at: int) -> Span | None:
    found = _SSN.match(text, at)
    return (at, found.end(), "ssn") if found else None


def account_at(text: str, at: int) -> Span | None:
    found = _ACCOUNT.match(text, at)
    return (at, found.end(), "account") if found else None


_CUED: dict[str, Callable[[str, int], Span | None]] = {"iban": iban_at, "ssn": ssn_at, "account": account_at}


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchors and what they call for; cues in small, capital and leading capital letters."""
    out = ahocorasick.Automaton()
    for sign, kind in (("@", "email"), ("+", "phone"), ("://", "url"), *((d, "digit") for d in "0123456789")):
        out.add_word(sign, (len(sign), kind))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                out.add_word(form, (len(form), kind))
    out.make_automaton()
    return out


def spans_of(text: str) -> list[Span]:
    """All spans of a text by start, then kind in the order of KINDS."""
    found, done = [], dict.fromkeys(("email", "phone", "card", "ip"), 0)
    for last, (length, kind) in automaton().iter(text):
        at = last + 1 - length
        if kind == "digit":
            if at >= done["card"]:
                done["card"], span = card_at(text, at)
                found.append(span)
            if at >= done["ip"]:
                done["ip"], spans = ips_at(text, at)
                found += spans
        elif kind == "email":
            done["email"], span = email_at(text, at, done["email"])
            found.append(span)
        elif kind == "phone":
            end, span = phone_at(text, at)
            done["phone"] = max(done["phone"], end)
            found.append(span)
        elif kind == "url":
            found.append(url_at(text, at))
        elif (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")) and (begin := cued(text, last + 1)) >= 0:
            found.append(_CUED[kind](text, begin))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted({s for s in found if s}, key=lambda s: (s[0], order[s[2]], s[1]))


SPANS = "array<struct<kind: string, start: long, end: long>>"


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, text, and its spans (kind, start, end), base kinds and added ones."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def scan(batches):
        one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for block in text_blocks(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t)] if t else [] for t in block["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([block["key"], block["text"], pa.array(spans, pa.list_(one))], ["key", "text", "spans"])

    return rows.mapInArrow(scan, f"key {kind}, text string, spans {SPANS}").withColumnsRenamed({"key": key, "text": text})


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and the text with each span replaced by its kind in brackets; of spans that overlap
    the earliest, then the longest, gives the name, and their union goes."""
    order = F.array_sort(F.col("spans"), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    t = F.col(text)

    def step(s, x):
        piece = F.concat(s["out"], t.substr(s["at"].cast("int") + F.lit(1), (x["start"] - s["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] >= s["at"], F.struct(piece.alias("out"), x["end"].alias("at"))).otherwise(F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at")))

    whole = F.aggregate(order, start, step, lambda s: F.concat(s["out"], t.substr(s["at"].cast("int") + F.lit(1), F.greatest(F.char_length(t) - s["at"].cast("int"), F.lit(0)))))
    return found(docs, key, text).select(key, F.when(F.size("spans") == 0, t).otherwise(whole).alias(text))


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    x = found(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in BASE]
    return x.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
