"""Token ids of whole texts with the ``tokenizers`` library.

No token of the vocabularies used here reaches over white space, so a text's
ids are the concatenation of the ids of its white-space separated words.  The
library encodes each word once and the worker remembers it; that memory is
bounded and forgets the words longest unused, which changes speed only.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import regex

#: Words and pieces of words that one Python worker remembers, in two halves.
WORDS_KEPT = 900_000
PIECES_KEPT = 500_000

#: How the vocabulary file splits a word, for plain and for Latin letters.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_LATIN_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LATIN_END = "ɐ"

_ENCODERS: dict[str, TextEncoder] = {}


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves, others as letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: b if b in plain else next(other) for b in range(256)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """A dictionary of bounded size: entries not asked for while half of it fills up are forgotten."""

    def __init__(self, size: int):
        self.half, self.new, self.old = size // 2, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class TextEncoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.pieces = Memory(WORDS_KEPT), Memory(PIECES_KEPT)
        self.added = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.by_word = self._splits_at_space()

    def _splits_at_space(self) -> bool:
        """Whether this file's steps make the ids of a word independent of other words, and are those known here."""
        probe = "Some WORDS, don't 1a É<x>.\nand \x1c İŉ é½ a_b"
        whole = self._whole(probe)
        return whole == b"".join(self._whole(w) for w in probe.split(" ")) and whole == b"".join(self._word(w) for w in probe.encode().split())

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])
            self.pieces.put(piece, found)
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if b"<|" in word and any(t in word for t in self.added) or max(text) >= _LATIN_END:
            return self._whole(text)
        if word.isascii() and text.isprintable():
            return b"".join([self._piece(p) for p in _ASCII_PIECES.findall(text.lower())])
        text = unicodedata.normalize("NFC", text).lower()
        return b"".join([self._piece(p.encode().decode("latin-1").translate(self.letters)) for p in _LATIN_PIECES.findall(text)])

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text.decode())
        memory, out = self.words, []
        known = memory.new
        for w in text.split():
            ids = known.get(w)
            if ids is None:
                ids = memory.get(w)
                if ids is None:
                    ids = self._word(w)
                    memory.put(w, ids)
                known = memory.new
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
