"""Deterministic randomness.

Results must not depend on partition count or task order, so sampling never
uses ``rand()``: every draw is a uniform number made from an md5 over the
keys that identify it (seed, row, item, ...).

    u(k1, k2, ..) = int(first 8 hex digits of md5("k1:k2:.."), 16) / 2**32

The same number is produced by :func:`u01_sql` in plain SQL (DuckDB form),
which is what the oracle queries use.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(*cols) -> Column:
    parts = [c if isinstance(c, Column) else F.lit(c) for c in cols]
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def u01(*cols) -> Column:
    """Uniform in [0, 1) from the md5 of the ':'-joined keys."""
    h = F.md5(_key(*cols))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def u01_sql(*exprs: str) -> str:
    """DuckDB text of the same uniform, for oracle SQL."""
    inner = ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs)
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {inner})), 1, 8)) AS BIGINT) / 4294967296.0)"


# MD5 of RFC 1321 over columns of words: constants and shifts of its steps.
_SINES = [int(abs(np.sin(i + 1)) * TWO_32) for i in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a key with its position that fit one block, and keys hashed at once (their words stay in the cache).
ONE_BLOCK, HASHED_AT_ONCE = 55, 1 << 13


def _md5_head(words: list[np.ndarray | int]) -> np.ndarray:
    """First word of the MD5 of one-block messages, given as 16 columns of words (a number: the same for all)."""
    a, b, c, d = (np.uint32(x) for x in _START)
    with np.errstate(over="ignore"):
        for i in range(61):  # the last three steps do not change the first word
            turn = i // 16
            if turn == 0:
                f, g = d ^ (b & (c ^ d)), i
            elif turn == 1:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif turn == 2:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            w = words[g]
            x = a + f + (np.uint32((_SINES[i] + w) % 2 ** 32) if isinstance(w, int) else w + np.uint32(_SINES[i]))
            left = _SHIFTS[turn][i % 4]
            a, b, c, d = d, b + ((x << np.uint32(left)) | (x >> np.uint32(32 - left))), b, c
        return b + np.uint32(_START[0])


def position_uniforms(keys: pa.Array, row: np.ndarray, pos: np.ndarray, end: str = "") -> np.ndarray:
    """:func:`u01` for many positions of few keys: u01(keys[row], pos) or, with ``end``, of these joined with it.

    The messages of a stretch are laid out as a matrix of bytes and hashed column by column."""
    heads = [k.encode() + b":" for k in keys.to_pylist()]
    tail = f":{end}".encode() if end else b""
    size = np.array([len(h) for h in heads], np.int64)
    out = np.empty(len(row))
    base = np.zeros((len(heads), 64), np.uint8)
    for i, h in enumerate(heads):
        base[i, :min(len(h), 64)] = np.frombuffer(h[:64], np.uint8)
    for at in range(0, len(row), HASHED_AT_ONCE):
        r, p = row[at:at + HASHED_AT_ONCE], pos[at:at + HASHED_AT_ONCE]
        digits = np.searchsorted(10 ** np.arange(1, 19), p, side="right") + 1
        n = size[r] + digits + len(tail)
        if n.max() > ONE_BLOCK:
            out[at:at + len(r)] = [int.from_bytes(hashlib.md5(b"%s%d%s" % (heads[i], j, tail)).digest()[:4]) / TWO_32 for i, j in zip(r.tolist(), p.tolist())]
            continue
        m = base[r]
        flat, first = m.reshape(-1), np.arange(len(r)) * 64 + size[r]
        rest = p.copy()
        for back in range(int(digits.max())):  # the last digit first
            some = slice(None) if back < digits.min() else digits > back
            flat[(first + digits - 1 - back)[some]] = 48 + rest[some] % 10
            rest //= 10
        for i, byte in enumerate(tail + b"\x80"):
            flat[first + digits + i] = byte
        used = (int(n.max()) + 4) // 4
        w = np.ascontiguousarray(m.view("<u4")[:, :used].T)
        u = _md5_head([*w, *[0] * (14 - used), (n * 8).astype(np.uint32), 0])
        out[at:at + len(r)] = u.byteswap() / TWO_32
    return out
