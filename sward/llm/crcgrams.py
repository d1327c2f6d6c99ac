"""crc32 of word n-grams (words joined by one space) on whole batches with numpy.

The crc register is linear: the register after A then B is the one after A, carried
over len(B) zero bytes, xor the one of B alone.  So the n-grams of a batch follow from
the registers of its words and tables that carry a register over a number of bytes.
"""

from __future__ import annotations

import zlib

import numpy as np

_POLY = 0xEDB88320


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(_POLY), t >> np.uint32(1))
    return t


_TABLE = _byte_table()
_FF = np.uint32(0xFF)


def _look(tables: np.ndarray, of, c: np.ndarray) -> np.ndarray:
    out = tables[of, 0, c & _FF]
    for k in (1, 2, 3):
        out = out ^ tables[of, k, (c >> np.uint32(8 * k)) & _FF]
    return out


def _carry_tables() -> list[np.ndarray]:
    """Tables [j, byte of the register, its value]: carried over j * 128**level bytes, for four levels."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    levels = []

    def step(c):
        return _TABLE[c & _FF] ^ (c >> np.uint32(8))

    for _ in range(4):
        t = np.empty((128, 4, 256), dtype=np.uint32)
        t[0] = one
        for j in range(1, 128):
            t[j] = step(t[j - 1])
        levels.append(t)

        def step(c, t=t):  # 128 times the step before
            return _look(t, 1, _look(t, 127, c))
    return levels


_CARRY = _carry_tables()


def carry(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers ``c`` after ``n`` zero bytes each (n < 2**28)."""
    c = _look(_CARRY[0], n & 127, c)
    for level in (1, 2, 3):
        far = np.flatnonzero(n >> (7 * level))
        if len(far) == 0:
            break
        c[far] = _look(_CARRY[level], (n[far] >> (7 * level)) & 127, c[far])
    return c


def word_registers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Register (from 0) after the bytes of each word."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, n = start[order], size[order]
    c = np.zeros(len(order), dtype=np.uint32)
    long = int(np.searchsorted(-n, -64, side="left"))  # words of over 64 bytes
    top = int(n[long]) if long < len(n) else 0
    for pos in range(top):
        k = int(np.searchsorted(-n, -pos, side="left"))  # words with a byte at pos
        m = slice(long, k)
        c[m] = _TABLE[(c[m] ^ data[at[m] + pos]) & _FF] ^ (c[m] >> np.uint32(8))
    for i in range(long):
        c[i] = zlib.crc32(data[at[i]:at[i] + n[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(c)
    out[order] = c
    return out


def gram_crcs(register: np.ndarray, size: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """crc32 of the k words from each word ``i`` on, joined by one space."""
    c, n = register[i], size[i]
    space = np.uint32(32)
    for j in range(1, k):
        c = _TABLE[(c ^ space) & _FF] ^ (c >> np.uint32(8))
        more = size[i + j]
        c = carry(c, more) ^ register[i + j]
        n = n + 1 + more
    full = np.full(len(c), 0xFFFFFFFF, dtype=np.uint32)
    return c ^ carry(full, n) ^ np.uint32(0xFFFFFFFF)
