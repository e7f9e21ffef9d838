"""Token ids of whole texts with a byte-level BPE vocabulary file, quickly and in bounded memory.

The file is a ``tokenizers`` JSON file. Its pre-tokenizer never joins text across a single space
that stands between two visible characters, so a text is cut there and the ids of each cut are
kept in a bounded cache: words recur. Cuts are encoded with ``tiktoken``, built from the same
vocabulary, which gives the ids of ``tokenizers`` and is several times faster. Texts in which a
space has other neighbours are cut only where the rule holds. Strings of the file's added tokens
inside a text get their ids, as in ``tokenizers``, or are ordinary text, as there with
``encode_special_tokens``.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: The pre-tokenizing pattern of byte-level BPE files, and its printable byte table.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

CACHED = 400_000
CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


class _NotApart(Exception):
    """A cut whose ends are not plain characters."""


def _byte_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """Ids as bytes of the cuts seen so far, filled on demand."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, cut: str) -> bytes:
        if not cut or not (_plain(cut[0]) and _plain(cut[-1])):
            raise _NotApart
        if len(self) >= CACHED:
            self.clear()
        ids = self[cut] = self.encode(self.lead + cut)
        return ids


def _plain(c: str) -> bool:
    return c.isalnum() or 0x21 <= ord(c) <= 0x7E


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, added_tokens: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        kind = (model.get("pre_tokenizer") or {}).get("type")
        if model["model"]["type"] != "BPE" or kind != "ByteLevel" or model.get("normalizer"):
            raise ValueError(f"not a byte-level BPE file: {path}")
        added = model.get("added_tokens", [])
        if added_tokens and any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens that take in or depend on their neighbours: {path}")
        special = {x["content"]: x["id"] for x in added}
        byte_of = _byte_of()
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in model["model"]["vocab"].items() if token not in special
        }
        self._bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(*ranks.values(), *special.values()) + 1, np.int64)  # bytes of each id
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        for token, i in special.items():
            self.lengths[i] = len(token.encode())
        self._added = {x: np.array([i], "<u4").tobytes() for x, i in special.items()} if added_tokens else {}
        # The longest of those that begin at one place, as in ``tokenizers``.
        longest = sorted(self._added, key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self._first, self._later = _Known(self._direct, ""), _Known(self._direct, " ")

    def _direct(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._split is None or not self._split.search(text):
            return self._plain_text(text)
        parts = self._split.split(text)  # every second one is an added token
        return b"".join(self._added[x] if i % 2 else self._plain_text(x) for i, x in enumerate(parts))

    def _plain_text(self, text: str) -> bytes:
        if not text:
            return b""
        cuts = text.split(" ")
        try:
            return self._join(cuts)
        except _NotApart:
            # Cuts only between letters or digits, which no run of blanks or signs can cross.
            cuts = CUT.split(text)
            head = [self._direct(cuts[0])]
            for cut in cuts[1:]:
                known = self._later.get(cut)
                head.append(self._direct(" " + cut) if known is None else known)
            return b"".join(head)

    def _join(self, cuts: list[str]) -> bytes:
        if len(cuts) == 1:
            return self._direct(cuts[0])
        return self._first[cuts[0]] + b"".join(map(self._later.__getitem__, cuts[1:-1])) + self._last(cuts[-1])

    def _last(self, cut: str) -> bytes:
        """The last cut may end in anything, for nothing follows it."""
        if not cut or not _plain(cut[0]):
            raise _NotApart
        known = self._later.get(cut)
        return self._direct(" " + cut) if known is None else known


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    """One encoder for each file, reading of added tokens and Python worker."""
    if (path, added_tokens) not in _ENCODERS:
        _ENCODERS[path, added_tokens] = Encoder(path, added_tokens)
    return _ENCODERS[path, added_tokens]
