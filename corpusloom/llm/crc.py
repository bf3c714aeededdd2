"""CRC-32 of joined byte strings from the CRC-32 of the parts, in arrays.

The CRC of parts one after another is the exclusive or of the parts' CRCs, each
multiplied by x to the power of 8 times the bytes after it, modulo the polynomial.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
_DIGIT = 1024


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials modulo the polynomial."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint32), np.asarray(b, np.uint32))
    out, b = np.zeros(a.shape, np.uint32), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def _powers(step: int) -> np.ndarray:
    """Powers 0 to _DIGIT of a polynomial."""
    out = [0x80000000]
    for _ in range(_DIGIT):
        out.append(int(multiplied(np.uint32(out[-1]), np.uint32(step))))
    return np.array(out, np.uint32)


class Joiner:
    """Joins CRCs of parts whose lengths are whole numbers of ``unit`` bytes."""

    def __init__(self, unit: int = 4):
        step = 0x80000000 >> 1  # x
        for _ in range(3):  # x to the 8
            step = int(multiplied(np.uint32(step), np.uint32(step)))
        base = 0x80000000
        for _ in range(unit):
            base = int(multiplied(np.uint32(base), np.uint32(step)))
        self.tables = [_powers(base)]
        while len(self.tables) < 4:
            self.tables.append(_powers(int(self.tables[-1][_DIGIT])))

    def shifted(self, crc: np.ndarray, units: np.ndarray) -> np.ndarray:
        """``crc`` with so many units of bytes after it."""
        left = np.asarray(units, np.int64)
        for table in self.tables:
            digit, left = left % _DIGIT, left // _DIGIT
            if digit.any():
                crc = multiplied(crc, table[digit])
            if not left.any():
                return crc
        raise ValueError("a text of more than 2**40 units")
