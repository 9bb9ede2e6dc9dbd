"""Fast exact encoding with public tokenizers of the tokenizers library.

Both vocabularies split a text into pre-tokens and merge within each of them, so the ids of a text
are the concatenation of the ids of its pre-tokens. For texts within a set of plain signs (Latin-1
without control signs) the split is done here, and the library encodes each distinct pre-token once;
any other text, and any that holds the content of an added token (such as <|endoftext|>, which is one id),
goes to the library whole. The results are equal either way, which tests check.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

from tokenizers import Tokenizer

_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = " \t\n\r"
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ÿ]*")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: Pre-token patterns of the two vocabularies over plain signs.
_SPLIT = {
    "word": re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
    "byte": re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
}


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for signs from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_SIGNS = _byte_signs()
#: Pre-tokens that a generation keeps.
PARTS = 300_000


class Kept(dict):
    """Results of ``make``, kept for arguments met before. Two generations of at most ``limit``: what is
    used again moves to the young one, so frequent arguments stay."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, x: str) -> bytes:
        if (out := self.old.get(x)) is None:
            out = self.make(x)
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        self[x] = out
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. kind: "word", "byte", or "" for a
    vocabulary without a known split, which encodes every text whole."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split, self.lower, self.known = _SPLIT.get(kind), kind == "word", Kept(self.merged, PARTS)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def merged(self, part: str) -> bytes:
        """Ids of one pre-token, by the library's merges alone."""
        signs = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def __call__(self, text: str) -> bytes:
        low = text.lower() if self.lower else text
        if self.split is None or not _PLAIN.fullmatch(text) or any(a in text.lower() for a in self.added if a[0] in text):
            return self.whole([text])[0]
        return b"".join(map(self.known.__getitem__, self.split.findall(low)))


@cache
def encoder(path: str, kind: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, kind)
