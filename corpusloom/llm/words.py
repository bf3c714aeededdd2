"""Words as the contracts define them: maximal runs outside ``[\\x20\\x09-\\x0D]``.

``bytes.split()`` splits at exactly these six bytes and ``bytes.lower()`` maps
exactly A-Z, so both are applied to UTF-8.
"""

from __future__ import annotations


def words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []
