"""Counts over one whole text, on which quality rules are based."""

from __future__ import annotations

import numpy as np

#: The six bytes of white space and the symbols counted.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words inside windows of ``n`` words that occur twice or more, the first included.

    Windows are named exactly by ranks: of pairs, of pairs of pairs, and so on.
    """
    m = len(words) - n + 1
    if m < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    rank, have = codes, 1
    while have < n:
        step = min(have, n - have)
        pair = rank[: len(words) - have - step + 1] * np.int64(len(words)) + rank[step : len(words) - have + 1]
        rank, have = np.unique(pair, return_inverse=True)[1], have + step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """In the order of ``NAMES``; a null text has no words and no lines."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = text.split()
    solid = text.translate(None, SPACE)
    chars = len(solid.decode("utf-8", "replace")) if not solid.isascii() else len(solid)
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))
