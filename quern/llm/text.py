"""Words of many texts at once, as positions in their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C55, pow(0x9E3779B97F4A7C55, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the life of the worker."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 20), base, U)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value begins with the end appended) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    low, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    return (np.frombuffer(data, np.uint8)[low : low + n] if n else np.zeros(0, np.uint8)), offsets - low


#: Scripts that are written without blanks: each of these characters is a word. (from, to)
_ALONE = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3040, 0x312F),
    (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
_SPACES = ((0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Punctuation and signs beyond ASCII.
_SIGNS = (
    (0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x37E, 0x37E), (0x387, 0x387), (0x55A, 0x55F), (0x589, 0x58A), (0x5BE, 0x5BE), (0x5C0, 0x5C0), (0x60C, 0x60D),
    (0x61B, 0x61F), (0x66A, 0x66D), (0x6D4, 0x6D4), (0x964, 0x965), (0xE4F, 0xE4F), (0xE5A, 0xE5B), (0x104A, 0x104F), (0x1680, 0x1680), (0x17D4, 0x17DA), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x2BFF),
    (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x303F), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFEFF, 0xFEFF), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40),
    (0xFF5B, 0xFF65), (0x1F000, 0x1FAFF),
)


def _among(code: np.ndarray, ranges: tuple) -> np.ndarray:
    edges = np.array([x for a, b in sorted(ranges) for x in (a, b + 1)])
    return np.searchsorted(edges, code, side="right") % 2 == 1


def bounds(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, apart: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word. inside: by byte, whether it is in words; apart: ranges of characters that divide words."""
    n = len(raw)
    own = inside[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        b = raw[np.minimum(lead[:, None] + np.arange(4), n - 1)].astype(np.int64)
        size = np.where(b[:, 0] < 0xE0, 2, np.where(b[:, 0] < 0xF0, 3, 4))
        code = np.where(size == 2, (b[:, 0] & 31) << 6 | b[:, 1] & 63, np.where(size == 3, (b[:, 0] & 15) << 12 | (b[:, 1] & 63) << 6 | b[:, 2] & 63, (b[:, 0] & 7) << 18 | (b[:, 1] & 63) << 12 | (b[:, 2] & 63) << 6 | b[:, 3] & 63))
        no = _among(code, apart)
        for k in range(4):
            own[lead[no & (size > k)] + k] = False
        alone = ~no & _among(code, _ALONE)
        edge[lead[alone]] = True
        edge[lead[alone] + size[alone]] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = own[:-1] & ~edge[1:n], own[1:] & ~edge[1:n]
    return np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1


_LETTERS = np.array([i > 127 or chr(i).isalnum() for i in range(256)])
_SOLID = np.array([not (chr(i).isspace() and i < 128) for i in range(256)])


def letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as runs of letters and digits; a character of a script without blanks is one."""
    return bounds(raw, offsets, _LETTERS, _SIGNS)


def solid(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as runs without white space; a character of a script without blanks is one."""
    return bounds(raw, offsets, _SOLID, _SPACES)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, add: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    n = len(raw)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((raw + U(add)) * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + U(1))
