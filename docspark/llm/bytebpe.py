"""Byte-level BPE ids by the tokenizers library, remembered for each word.

The pre-tokenizer never joins a word with the space that follows it, so a text is the sequence of its space-led words wherever
single spaces stand between characters that are no white space. Each distinct word goes through the library once per worker, as
long as there is room; other texts go through it whole.
"""

from __future__ import annotations

import json
import re
import struct

import regex

#: Words, and parts of words, that a worker remembers at most.
REMEMBERED, REMEMBERED_PARTS = 800_000, 1_000_000
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words in which all versions of Unicode agree on letters, digits and white space.
_PLAIN = re.compile(r"[!-~\n¡-ɏ]+")


class _Known(dict):
    def __init__(self, make, most=REMEMBERED):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class _Irregular(Exception):
    pass


class ByteBpe:
    """encode(text) gives the ids as little-endian integers of `width` bytes, exactly as the library does without special tokens.

    plain_specials: whether the strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.path, self.plain_specials = path, plain_specials
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        with open(path) as f:
            told = json.load(f)
        steps = told["pre_tokenizer"]
        self.simple = told["normalizer"] is None and steps["type"] == "ByteLevel" and not steps["add_prefix_space"] and not told["truncation"] and not told["padding"]
        self.specials = [] if plain_specials else [t["content"] for t in told["added_tokens"]]
        self.vocabulary = self.library.get_vocab_size()
        self.width, self.code = (2, "H") if self.vocabulary <= 1 << 16 else (4, "I")
        self.parts, self.first, self.later = _Known(self._whole, REMEMBERED_PARTS), _Known(lambda w: self._word(w, w)), _Known(lambda w: self._word(w, " " + w))

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _word(self, word: str, led: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        return b"".join(map(self.parts.__getitem__, PATTERN.findall(led))) if _PLAIN.fullmatch(word) else self._whole(led)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.simple and not any(s in text for s in self.specials):
            words = iter(text.split(" "))
            try:
                return self.first[next(words)] + b"".join(map(self.later.__getitem__, words))
            except _Irregular:
                pass
        return self._whole(text)


_encoders: dict[tuple, ByteBpe] = {}


def encoder(path: str, plain_specials: bool = False) -> ByteBpe:
    """One encoder for each file, setting and process."""
    key = (path, plain_specials)
    if key not in _encoders:
        _encoders[key] = ByteBpe(*key)
    return _encoders[key]
