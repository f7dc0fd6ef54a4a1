"""Token ids and counts of byte-pair tokenizers through a table of pre-tokens.

A byte-pair tokenizer splits a text into pre-tokens by a pattern and merges within each, so a
pre-token has the same ids wherever it stands. In both families here a pre-token never reaches
over a space that a visible character follows, so a text falls apart there first and what stands
between two such spaces is looked up as one piece; only pieces not met before are matched against
the pattern and merged by the library's model. Texts with characters on which the Unicode tables
of Python and of the library may differ go to the library whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

#: Pieces that a worker's cache holds, and the longest it holds; others are encoded each time. Results do not depend on either.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 48

#: Fixed patterns of the two families of tokenizers, as their files state them.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Where a byte-level text falls apart: before a space that no white space follows.
_AT_SPACE = regex.compile(r" (?=\S)")
_WIDE_SPACE = regex.compile(r" (?:\s|$)")
_PLAIN = re.compile(r"[A-Za-z]+")
_STOPS = ".,;:!?"

#: Most texts have no character outside these few ranges, none of them unsafe; only others need the long table.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\u0377\u2010-\u2027\u20a0-\u20bf]")

_UNSAFE: re.Pattern | None = None


def unsafe_characters() -> re.Pattern:
    """Characters that Python's tables leave unassigned or take for white space alone, and those whose lower case depends on neighbours."""
    global _UNSAFE
    if _UNSAFE is None:
        newer = regex.compile(r"\p{Cn}").match
        spans, start = [], None
        for c in range(0x80, sys.maxunicode + 2):
            odd = c <= sys.maxunicode and (unicodedata.category(chr(c)) == "Cn" or c == ord("\u03a3") or (c > 0x24F and newer(chr(c)) is not None))
            if odd and start is None:
                start = c
            elif not odd and start is not None:
                spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        _UNSAFE = re.compile(f"[\\x1c-\\x1f{''.join(spans)}]")
    return _UNSAFE


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models use for each byte: itself where printable, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(0x100)}


class PreTokens(dict):
    """Piece -> what ``value`` makes of its ids, ``join`` of several; a miss is encoded and kept while there is room."""

    def __init__(self, path: str, value: Callable[[list[int]], object], join: Callable[[list], object], known: dict | None = None):
        super().__init__(known or {})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.value, self.join = value, join
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        kinds = [p["type"] for p in (form["pre_tokenizer"].get("pretokenizers") or [form["pre_tokenizer"]])]
        self.words = kinds[0] == "Split"
        self.pattern = regex.compile(WORD_LEVEL if self.words else BYTE_LEVEL)
        self.specials = {t["content"]: t["id"] for t in form["added_tokens"]}
        self.at_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.known = len(self)
        self.unsafe = unsafe_characters()
        self.letters = _byte_letters()
        self.stops: dict = {}

    def ids(self, token: str) -> list[int]:
        """Of one pre-token, by the library's model."""
        letters = token if _PLAIN.fullmatch(token) else token.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def merged(self, piece: str):
        """Of one piece, by the pattern and the library's model."""
        return self.value([i for token in self.pattern.findall(piece) for i in self.ids(token)])

    def __missing__(self, piece: str):
        lead = "" if self.words else " "
        core = piece.rstrip(_STOPS)
        if piece.isalpha():  # one pre-token, as letters are what \p{L} matches
            out = self.value(self.ids(lead + piece))
        elif core.isalpha() and len(core) <= CACHE_LENGTH:  # letters, then a run of other marks: two
            stops = piece[len(core) :]
            if stops not in self.stops:
                self.stops[stops] = self.merged(stops)
                if len(self.stops) > 1000:
                    self.stops = {stops: self.stops[stops]}
            out = self.join([self[core], self.stops[stops]])
        else:
            out = self.merged(lead + piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= self.known + CACHE_ENTRIES:
                for key in list(self)[self.known :]:
                    del self[key]
            self[piece] = out
        return out

    def of(self, text: str):
        """The value of a whole text."""
        if _UNUSUAL.search(text) and self.unsafe.search(text):
            return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if "<|" not in text or self.at_specials is None:
            return self.join(self.pieces(text))
        out: list = []
        for part in self.at_specials.split(text):
            if part in self.specials:
                out.append(self.value([self.specials[part]]))
            else:
                out += self.pieces(part)
        return self.join(out)

    def pieces(self, text: str) -> list:
        if self.words:
            text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            return list(map(self.__getitem__, text.split()))
        parts = _AT_SPACE.split(text) if _WIDE_SPACE.search(text) else text.split(" ")
        return [self.merged(parts[0]), *map(self.__getitem__, parts[1:])]


def frequent_lengths(path: str) -> dict[str, int]:
    """Pieces that are entries of the vocabulary, without their leading space, with the number of tokens that the library gives them.

    A byte-pair vocabulary lists the pre-tokens that were frequent where it was made. The table has
    at most as many entries as the vocabulary, whatever the corpus.
    """
    tokenizer = Tokenizer.from_file(path)
    entries = tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size())], skip_special_tokens=False)
    table = PreTokens(path, len, sum)
    pieces = sorted({p[1:] for p in entries if p[:1] == " " and len(p) > 1 and "\ufffd" not in p and not regex.search(r"\s", p[1:])})
    lengths = [len(e.ids) for e in tokenizer.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
    return {p: n for p, n in zip(pieces, lengths, strict=True) if not table.unsafe.search(p)}
