"""Sparse n-grams of bytes.

A weight belongs to each pair of neighbouring bytes (rare pairs weigh more). A run of 2 or 3 bytes always
is an n-gram; a longer one, of 128 at most, where both its outer pairs weigh more than all pairs
between. Whether a run is one depends on its own bytes only, so a literal's n-grams occur in every
text with the literal. all_spans() gives them all; cover() the fewest that cover a literal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 128
_COMMON = "th1 he2 in3 er4 an5 re6 on7 at8 en9 nd10 ti11 es12 or13 te14 of15 ed16 is17 it18 al19 ar20 et12 rn15 un18 st14 ng16 le17 ct20"
_RANKS = {x[:2]: int(x[2:]) for x in _COMMON.split()}
_SIDES = {
    ("l", "s"): 15, ("s", "s"): 5, ("U", "U"): 60, ("d", "d"): 80, ("d", "l"): 70, ("U", "d"): 75, ("l", "p"): 120, ("U", "p"): 130, ("p", "p"): 140,
    ("p", "s"): 90, ("U", "s"): 50, ("d", "s"): 60, ("d", "p"): 110,
}


def _class(b: int) -> str:
    c = chr(b)
    if b >= 128:
        return "n"
    if c in " \t\n\r":
        return "s"
    if b < 32 or b == 127:
        return "c"
    return "l" if c.islower() else "U" if c.isupper() else "d" if c.isdigit() else "p"


def _weights() -> np.ndarray:
    classes = [_class(b) for b in range(256)]
    w = np.zeros((256, 256), np.int64)
    for a in range(256):
        for b in range(256):
            x, y = classes[a], classes[b]
            if x == "n" or y == "n":
                v = 230 if x == y else 220
            elif x == "c" or y == "c":
                v = 200 if x == y else 180
            elif (x, y) == ("l", "l"):
                own = _RANKS.get(chr(a) + chr(b))
                v = 3 + own if own is not None else 30 + ((7 * a ^ 13 * b) % 20)
            elif (x, y) in (("l", "U"), ("U", "l")):
                v = 100 if x == "l" else 40
            else:
                v = _SIDES.get((x, y)) or _SIDES[(y, x)]
            w[a, b] = min(251, max(1, v * 7 // 10 if a == b else v))
    return w


WEIGHTS = _weights()
_NARROW = WEIGHTS.astype(np.uint8)
U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEPT: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_KEPT[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 16), base, U)
            x[0] = 1
            _KEPT[i] = np.multiply.accumulate(x)
    return _KEPT[0][:n], _KEPT[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    return _mixed(x.copy())


def _mixed(x: np.ndarray) -> np.ndarray:
    """_mix in place."""
    for shift, by in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        x ^= x >> U(shift)
        x *= U(by)
    x ^= x >> U(33)
    return x


#: by length; a key of one length isn't a key of another
_LENGTHS = _mix(np.arange(LONGEST + 1, dtype=U))


def pair_weights(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, np.uint8)
    return WEIGHTS[d[:-1], d[1:]] if len(d) > 1 else np.zeros(0, np.int64)


def spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of all n-grams of texts laid end to end; ends: for each byte where its text ends."""
    n = len(raw)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = np.flatnonzero(ends[:-1] - np.arange(n - 1) >= 2)
    three = two[ends[two] - two >= 3]
    w = _NARROW[raw[:-1], raw[1:]]
    w[ends[:-1] - np.arange(n - 1) < 2] = _APART
    s, m = _longer(w, n - 1)
    return np.concatenate([two, three, s]), np.concatenate([np.full(len(two), 2), np.full(len(three), 3), m])


#: The weight of a pair of two texts' bytes, above all others; from DENSE on of the places being left, all are looked at.
_APART, _DENSE = 255, 1 / 8


def _longer(w: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the n-grams of four bytes and more that begin at the first places. w: the weights of the pairs."""
    w = np.concatenate([w, np.full(LONGEST, _APART, np.uint8)])
    outer, inside = w[:begin], w[1 : begin + 1].copy()
    live = inside < outer
    live &= outer < _APART
    starts, lengths, size = [], [], 4
    while size <= LONGEST and np.count_nonzero(live) > begin * _DENSE:  # inside: the most of the pairs between; it stays below the first pair
        last = w[size - 2 : size - 2 + begin]
        ok = inside < last
        ok &= live
        ok &= last < _APART
        starts.append(np.flatnonzero(ok))
        lengths.append(size)
        np.maximum(inside, last, out=inside)
        live &= inside < outer
        size += 1
    at = np.flatnonzero(live)
    outer, inside = outer.take(at), inside.take(at)
    while size <= LONGEST and len(at):
        last = w.take(at + (size - 2))
        starts.append(at[(inside < last) & (last < _APART)])
        lengths.append(size)
        inside = np.maximum(inside, last)
        keep = np.flatnonzero(inside < outer)
        at, outer, inside = at.take(keep), outer.take(keep), inside.take(keep)
        size += 1
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.repeat(np.array(lengths, np.int64), [len(x) for x in starts])


def _hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    up, down = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, U)
    sums[0], sums[1:] = 0, raw
    sums[1:] += U(1)
    sums[1:] *= up[: len(raw)]
    np.cumsum(sums, out=sums)
    h = sums.take(start + length)
    h -= sums.take(start)
    h *= down.take(start)
    h += _LENGTHS.take(length)
    return _mixed(h)


#: A gram's key is of 48 bits. Two grams of one key only make a document a candidate in vain. PIECE: bytes of text that are
#: worked on at once, so that what is needed beside the result doesn't grow with the texts.
_BITS, MOST_ROWS, PIECE = 16, 1 << 16, 1 << 18


def codes(column: pa.Array) -> np.ndarray:
    """key << _BITS | row of the distinct n-grams of each value of a binary column of at most MOST_ROWS values, in order."""
    if len(column) > MOST_ROWS:
        raise ValueError("too many values at once")
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    low, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if n < 2:
        return np.zeros(0, U)
    offsets = offsets - low
    raw = np.frombuffer(data, np.uint8)[low : low + n]
    both, at = np.empty(n, U), 0
    for a in range(0, n, PIECE):
        z = min(a + PIECE + LONGEST - 1, n)  # an n-gram belongs to the piece that it begins in
        first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, z, "left"))
        edge = np.clip(offsets[first : last + 1], a, z) - a
        size = np.diff(edge)
        for x in _codes(raw[a:z], np.repeat(np.arange(first, last, dtype=np.uint16), size), min(PIECE, n - a)):
            if at + len(x) > len(both):  # texts with few repeats
                both.resize(len(both) + max(n // 8, len(x)), refcheck=False)
            both[at : at + len(x)] = x
            at += len(x)
    both.resize(at, refcheck=False)
    return _distinct(both)


def _codes(raw: np.ndarray, row: np.ndarray, starts: int) -> list[np.ndarray]:
    """The same of a piece, for n-grams that begin in its first bytes: of two bytes, of three and of more, each in no order.
    row: for each byte. Short n-grams are told apart by their bytes, before they are hashed: most are repeats."""
    pairs, threes = (max(min(starts, len(raw) - k), 0) for k in (1, 2))
    code = raw[:-1].astype(np.uint16)
    code <<= 8
    code |= raw[1:]
    w = _NARROW.ravel().take(code.astype(np.intp))
    apart = np.flatnonzero(row[:-1] != row[1:])  # the last bytes of texts
    w[apart] = _APART
    s, m = _longer(w, pairs)
    low = row[0]
    own = (row[:pairs] - low).astype(np.uint32)
    two = own << np.uint32(16)
    two |= code[:pairs]
    none = apart[apart < pairs]  # what lies in two texts goes to the end
    two[none] = ~np.uint32(0)
    two = _distinct(two, len(none))
    three = own[:threes].astype(np.uint32 if row[-1] - low < 256 else U)
    three <<= 24
    three |= code[:threes].astype(np.uint32) << np.uint32(8)
    three |= raw[2 : threes + 2]
    none = np.union1d(apart[apart < threes], apart[(apart > 0) & (apart <= threes)] - 1)
    three[none] = ~three.dtype.type(0)
    three = _distinct(three, len(none)).astype(U)
    mask, low = U(((1 << 48) - 1) << _BITS), U(low)
    short = _short(2).take((two & np.uint32(0xFFFF)).astype(np.intp)) & mask
    short |= (two >> np.uint32(16)) + low
    x = _mixed((three & U(0xFFFFFF)) | U(3 << 32))
    x &= mask
    x |= (three >> U(24)) + low
    long = _hashes(raw, s, m)
    long &= mask
    long |= row.take(s)
    return [short, x, _distinct(long)]


def _distinct(both: np.ndarray, less: int = 0) -> np.ndarray:
    """In order, each once; without so many of the last. The array is used up."""
    both.sort()
    both = both[: len(both) - less]
    at, last = 0, None
    for a in range(0, len(both), PIECE):  # in place, as it may be all of a shard
        x = both[a : a + PIECE]
        new = np.empty(len(x), bool)
        new[0] = x[0] != last
        np.not_equal(x[1:], x[:-1], out=new[1:])
        last = x[-1]
        if at < a or not new.all():
            x = x[new]
            both[at : at + len(x)] = x
        at += len(x)
    return both[:at]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the distinct n-grams of each value of a binary column of at most MOST_ROWS values, by key and row."""
    return parted(codes(column))


def parted(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of codes()."""
    return (both >> U(_BITS)).astype(np.int64), (both & U(MOST_ROWS - 1)).astype(np.int64)


def edges(both: np.ndarray) -> np.ndarray:
    """Where each key of codes() begins, and the end."""
    if not len(both):
        return np.zeros(1, np.int64)
    new = np.empty(len(both), bool)
    new[0] = True
    for a in range(1, len(both), PIECE):
        x = both[a - 1 : a + PIECE] >> U(_BITS)
        new[a : a + PIECE] = x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(both))


_PAIRS: list[np.ndarray] = []


def _short(size: int) -> np.ndarray:
    """The hashes of all pairs of bytes."""
    if not _PAIRS:
        _PAIRS.append(_mix(np.arange(65536, dtype=U) | U(size << 32)))
    return _PAIRS[0]


def all_spans(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each n-gram of the bytes, by start and end."""
    raw = np.frombuffer(data, np.uint8)
    s, n = spans(raw, np.full(len(raw), len(raw)))
    return sorted(zip(s.tolist(), (s + n).tolist()))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct n-grams of each value of a binary column, by row and key."""
    key, row = packed(column)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def key(gram: bytes) -> int:
    raw = np.frombuffer(gram, np.uint8)
    if len(raw) <= 3:
        h = int(_mix(np.array([int.from_bytes(gram) | len(raw) << 32], U))[0])
    else:
        h = int(_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])
    return h >> _BITS


def cover(data: bytes) -> list[bytes]:
    """The fewest n-grams that cover all pairs of a literal: each time the one that begins at or before the
    first bare pair and reaches farthest (of equals the earliest)."""
    reach: dict[int, int] = {}
    for s, e in all_spans(data):
        reach[s] = max(e, reach.get(s, 0))
    out, bare = [], 0
    while bare < len(data) - 1:
        s = max((k for k in reach if k <= bare), key=lambda k: (reach[k], -k))
        out.append(data[s : reach[s]])
        bare = reach[s] - 1
    return out
