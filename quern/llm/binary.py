"""Token ids in compressed binary blocks: a context-mixing range coder.

Texts become ids of a public byte-level BPE vocabulary (its file is a parameter). Ids are cut into blocks
of `block` ids; a block starts from nothing and can be decoded by itself, and its CRC-32 is that of
its ids as little-endian 16-bit numbers.

In a block each id is coded against a mixture of three orders. What followed the same two ids the last `SLOTS2` times,
and the same id the last `SLOTS1` times, are slots, each with a weight; slots that say the same add up to one probability.
The rest of the range is order 0: the frequencies of the ids that no slot foretold. Slots move with every id. Weights
are learned for each class of what the slots look like (how many there are of each order, whether the latest two of an
order agree, and whether the orders do) from how often each slot was right; they and the frequencies of order 0 adapt at
the ends of growing segments. The mixture is one interval for each id, which drives a carry-less 64-bit range coder
that writes 16-bit words.

As the encoder knows the ids, all slots of a block are found by sorting contexts, and the range
coder advances many blocks at once, one step of all in each pass. The decoder goes id by id.

Defined results: a null text is a part of length -1 and an empty one of length 0, without ids. A null
doc_id is carried. Rows are coded each, in the order they come; equal rows are coded again. A long text
runs over several blocks (starts tell where each part begins). An empty table gives no blocks.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pick, slices
from quern.llm.text import powers

VOCABULARY, BLOCK, LANES = "/opt/tokenizers/byte_bpe_50k.tiktoken", 16384, 512
_SPLIT = regex.compile(r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
SLOTS2, SLOTS1, _MIX, _STEP, _UNIT = 3, 6, 11, 64, 240
U = np.uint64
_SLOTS = SLOTS2 + SLOTS1
_CLASSES = (SLOTS2 + 1) * (SLOTS1 + 1) * 8
#: by class: whether each slot says something; the escape always does
_THERE = np.concatenate([np.arange(SLOTS2) < np.arange(_CLASSES)[:, None] // 8 // (SLOTS1 + 1), np.arange(SLOTS1) < np.arange(_CLASSES)[:, None] // 8 % (SLOTS1 + 1), np.ones((_CLASSES, 1), bool)], axis=1)
_PRIOR = np.array([72] * SLOTS2 + [36] * SLOTS1 + [240])
SCHEMA = "doc_ids array<long>, starts array<long>, lengths array<long>, n_ids long, crc long, n_bytes long, payload binary"


#: classes of bytes: 0 letter (and all beyond ASCII), 1 digit, 2 other sign, 3 space, 4 other white space
_CLASS = np.array([0 if b > 127 or chr(b).isalpha() else 1 if chr(b).isdigit() else 3 if b == 32 else 4 if b in b"\t\n\v\f\r\x1c\x1d\x1e\x1f" else 2 for b in range(256)], np.uint8)
#: characters beyond ASCII that aren't letters, or white space that the byte classes don't know: such texts take the pattern itself
_ODD = regex.compile(r"[^\x00-\x1b\x20-\x7f\p{L}]")
def pieces(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces begin in texts laid end to end that begin at `first`; the texts have no _ODD characters."""
    n = len(raw)
    kind = _CLASS[raw]
    edge = np.zeros(n, bool)
    edge[first] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[edge] = 9
    solid = kind < 3
    start = edge | (solid & (before != kind))
    # one space goes with what follows; of other white space the last before a word is a piece, the rest another
    white = ~solid
    start |= white & (before < 3)
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & solid[1:] & ~edge[1:]
    start |= last
    lone = last & (kind == 3)
    start[1:] &= ~(lone[:-1] & ~edge[1:])
    start[1:] |= (last & (kind == 4))[:-1]
    # 's 't 'd 'm 'll 've 're at the beginning of a run of signs
    at = np.flatnonzero((raw == 39) & start)
    if len(at):
        pad = np.concatenate([raw, np.zeros(3, np.uint8)])
        ends = np.append(np.flatnonzero(edge), n)
        stop = ends[np.searchsorted(ends, at, side="right")]
        a, b = pad[at + 1], pad[at + 2]
        one = np.isin(a, np.frombuffer(b"sdmt", np.uint8)) & (at + 1 < stop)
        two = ~one & (((a == 108) & (b == 108)) | ((a == 118) & (b == 101)) | ((a == 114) & (b == 101))) & (at + 2 < stop)
        for hit, size in ((one, 2), (two, 3)):
            own = at[hit]
            start[own + 1] = False
            nxt, limit = own + size, stop[hit]
            ok = nxt < limit
            after = nxt[ok][kind[nxt[ok]] == 0]
            start[after] = True
    return np.flatnonzero(start)


class Words:
    """Ids of texts. Pieces are cut and hashed for many texts at once; each different piece is looked up once,
    and its ids kept for the life of the worker within a bound."""

    def __init__(self, path: str, most: int = 400_000):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=_SPLIT.pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.most, self.kept = most, {}
        self.size = max(self.ranks.values()) + 1
        if self.size > 65536:
            raise ValueError("ids must fit 16 bits")

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = [np.zeros(0, np.uint16)] * len(texts)
        fast = []
        for i, t in enumerate(texts):
            if t and not t.isascii() and _ODD.search(t) or t.isascii() and any(c in t for c in "\x1c\x1d\x1e\x1f"):
                out[i] = np.array(self.bpe.encode_ordinary(t), np.uint16)
            elif t:
                fast.append(i)
        if not fast:
            return out
        data = [texts[i].encode() for i in fast]
        whole = b"".join(data)
        raw = np.frombuffer(whole, np.uint8)
        first = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        begin = pieces(raw, first[:-1])
        end = np.append(begin[1:], len(raw))
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        hashes = (sums[end] - sums[begin]) * down[begin]
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        which = np.empty(len(begin), np.int64)
        which[order] = np.cumsum(new) - 1
        some = order[new]
        if len(self.kept) > self.most:
            self.kept.clear()
        kept, own = self.kept, [whole[s:e] for s, e in zip(begin[some].tolist(), end[some].tolist())]
        ids = [*map(kept.get, own)]
        encode_one = self.bpe._core_bpe.encode_single_piece  # a piece isn't cut again
        for i in [i for i, got in enumerate(ids) if got is None]:
            ids[i] = kept[own[i]] = array("H", encode_one(own[i])).tobytes()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat = np.frombuffer(b"".join(ids), np.uint16)
        base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        own = sizes[which]
        stop = np.cumsum(own)
        at = np.arange(stop[-1]) + np.repeat(base[which] - (stop - own), own)
        all_ids = flat[at]
        cut = np.concatenate([[0], stop])[np.searchsorted(begin, first)]
        for k, i in enumerate(fast):
            out[i] = all_ids[cut[k] : cut[k + 1]]
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def words(path: str = VOCABULARY) -> Words:
    return Words(path)


def cuts(n: int) -> list[int]:
    """Where segments begin: 0, 256, 512, 1024, then each 2048."""
    return [c for c in [0, 256, 512, 1024, *range(2048, max(n, 2048), 2048)] if c < max(n, 1)]


def _slots(x: np.ndarray) -> np.ndarray:
    """What each slot says at each position, -1 for nothing: those of order 2 first, the latest first."""
    n = len(x)
    out = np.full((_SLOTS, n), -1, np.int32)
    for order, slots, base in ((2, SLOTS2, 0), (1, SLOTS1, SLOTS2)):
        if n <= order:
            continue
        kind = np.uint32 if order == 1 and n <= 1 << 16 else U
        bits = kind(max(1, (n - 1).bit_length()))
        key = x[: n - order].astype(kind)
        if order == 2:
            key = key << U(16) | x[1 : n - 1].astype(U)
        key = key << bits | np.arange(n - order, dtype=kind)
        key.sort()
        at = (key & ((kind(1) << bits) - kind(1))).astype(np.int64)
        key >>= bits
        follow, m = x[at + order].astype(np.int32), len(at)
        back = np.empty(m, np.int64)
        back[at] = np.arange(m)
        said = np.full((slots, m), -1, np.int32)
        for r in range(1, min(slots, m - 1) + 1):
            said[r - 1, r:] = np.where(key[r:] == key[:-r], follow[:-r], -1)
        out[base : base + slots, order:] = said.take(back, axis=1)
    return out


def _classes(g: np.ndarray) -> np.ndarray:
    there = (g >= 0).view(np.int8)
    m2, m1 = there[:SLOTS2].sum(axis=0, dtype=np.int8).astype(np.int32), there[SLOTS2:].sum(axis=0, dtype=np.int8).astype(np.int32)
    return (m2 * (SLOTS1 + 1) + m1) * 8 + ((g[0] == g[1]) & (m2 > 1)) * 4 + ((g[SLOTS2] == g[SLOTS2 + 1]) & (m1 > 1)) * 2 + ((g[0] == g[SLOTS2]) & (m2 > 0))


def _weights(credit: np.ndarray) -> np.ndarray:
    """(..., classes, slots and escape) credits as weights that add to 1 << _MIX; slots that say nothing have 0."""
    c = (credit + _PRIOR) * _THERE
    w = (c * ((1 << _MIX) - _SLOTS - 1) // c.sum(axis=-1, keepdims=True) + 1) * _THERE
    w[..., -1] += (1 << _MIX) - w.sum(axis=-1)
    return w


def model(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coder's step for each id of a block: (cumulative, frequency, total)."""
    n, wide = len(x), _SLOTS + 1
    g = _slots(x)
    hit = g == x.astype(np.int32)
    number = hit.view(np.int8).sum(axis=0, dtype=np.int8)
    known = number > 0
    escape = np.flatnonzero(~known)
    begin = cuts(n)
    count = len(begin)
    place = np.repeat(np.arange(count), np.diff([*begin, n])) * _CLASSES + _classes(g)
    found = [np.flatnonzero(h) for h in hit]
    slot, at = np.repeat(np.arange(_SLOTS), [len(f) for f in found]), np.concatenate(found)
    where = place[at] * wide + slot
    credit = np.bincount(where, (_UNIT // np.maximum(number, 1).astype(np.int32))[at], minlength=count * _CLASSES * wide).astype(np.int64).reshape(-1, wide)
    credit[:, -1] = np.bincount(place[escape], minlength=len(credit)) * _UNIT
    credit = credit.reshape(count, _CLASSES, wide)
    credit = np.concatenate([np.zeros((1, _CLASSES, wide), np.int64), credit.cumsum(axis=0)[:-1]])
    w = _weights(credit).reshape(-1, wide)
    first = np.full(n, _SLOTS, np.int8)
    first[at[::-1]] = slot[::-1]  # the lowest is written last
    freq = np.bincount(at, w.ravel()[where], minlength=n).astype(np.int64)
    freq[escape] = w[place[escape], _SLOTS]
    before = (w.cumsum(axis=1) - w).ravel()[place * wide + first]
    # a slot behind the first that is right may say what one before it says: it is counted with that one
    late = np.flatnonzero(known & (first > 0))
    own, until = g.take(late, axis=1), first[late]
    same = np.zeros((_SLOTS, len(late)), bool)
    for t in range(_SLOTS - 1):
        same[t + 1 :] |= (own[t + 1 :] == own[t]) & (until > t)
    same &= until < np.arange(_SLOTS, dtype=np.int8)[:, None]
    before[late] += (w.take(place[late], axis=0)[:, :_SLOTS] * same.T).sum(axis=1)
    total, part, low = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
    edges = np.searchsorted(escape, [*begin, n])
    ids = x[escape]
    order = np.argsort(ids, kind="stable")
    new = np.ones(len(ids), bool)
    new[1:] = ids[order[1:]] != ids[order[:-1]]
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new) - 1
    seen = np.zeros(np.count_nonzero(new), np.int64)  # by rank: how often order 0 has seen an id in the segments before
    for j, s in enumerate(begin):
        e = begin[j + 1] if j + 1 < count else n
        own, at = rank[edges[j] : edges[j + 1]], escape[edges[j] : edges[j + 1]]
        low[at], part[at] = ids[edges[j] : edges[j + 1]] + _STEP * (np.cumsum(seen) - seen).take(own), 1 + _STEP * seen.take(own)
        total[s:e] = size + _STEP * edges[j]
        seen += np.bincount(own, minlength=len(seen))
    cum = before * total
    cum[escape] += low[escape] * freq[escape]
    return cum, freq * np.where(known, total, part), total << _MIX


_TOP, _BOT, _MASK = U(1 << 48), U(1 << 32), U((1 << 32) - 1)


def code(steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """Range-codes the steps of many blocks together."""
    order = sorted(range(len(steps)), key=lambda i: -len(steps[i][0]))
    counts = [len(steps[i][0]) for i in order]
    most, lanes = counts[0] if counts else 0, len(order)
    grid = np.ones((most, 3, lanes), np.uint32)
    for lane, i in enumerate(order):
        for k in range(3):
            grid[: counts[lane], k, lane] = steps[i][k]
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    # what is shifted out, for all lanes at once: words and whether each lane wrote one
    said, wrote = np.zeros((2 * most + 8, lanes), np.uint16), np.zeros((2 * most + 8, lanes), bool)
    near, short, sums, word = np.empty(lanes, bool), np.empty(lanes, bool), np.empty(lanes, U), np.empty(lanes, U)
    wide, fixed = np.empty((3, lanes), U), np.repeat(np.array([_TOP, _BOT, 48, 16], U)[:, None], lanes, axis=1)  # numbers become arrays on each call
    row, active = 0, lanes
    views = None
    for t in range(most):
        while counts[active - 1] <= t:
            active -= 1
            views = None
        if views is None:
            views = [x[:active] for x in (low, span, near, short, sums, word, *wide, *fixed)]
            lo, sp, ne, sh, su, wo, cum, freq, total, top, bottom, by48, by16 = views
            step = wide[:, :active]
        step[:] = grid[t, :, :active]
        np.floor_divide(sp, total, out=sp)
        np.multiply(cum, sp, out=cum)
        np.add(lo, cum, out=lo)
        np.multiply(sp, freq, out=sp)
        while True:
            np.add(lo, sp, out=su)
            np.bitwise_xor(su, lo, out=su)
            np.less(su, top, out=ne)
            np.less(sp, bottom, out=sh)
            np.logical_or(ne, sh, out=sh)
            if not sh.any():
                break
            np.greater(sh, ne, out=ne)
            if ne.any():
                sp[ne] = (~lo[ne] + U(1)) & _MASK
            np.right_shift(lo, by48, out=wo)
            if row == len(said):
                said, wrote = np.concatenate([said, np.zeros_like(said)]), np.concatenate([wrote, np.zeros_like(wrote)])
            said[row, :active], wrote[row, :active] = wo, sh
            row += 1
            np.multiply(sh, by16, out=wo)
            np.left_shift(lo, wo, out=lo)
            np.left_shift(sp, wo, out=sp)
    done = [b""] * lanes
    tail = np.stack([low >> U(48 - 16 * k) & U(0xFFFF) for k in range(4)], axis=1).astype(">u2") if lanes else None
    said, wrote = np.ascontiguousarray(said[:row].T), np.ascontiguousarray(wrote[:row].T)
    for lane, i in enumerate(order):
        done[i] = said[lane][wrote[lane]].astype(">u2").tobytes() + tail[lane].tobytes()
    return done


def encode(blocks: list[np.ndarray], size: int) -> list[bytes]:
    return code([model(x, size) for x in blocks])


def decode(payload: bytes, n: int, size: int, crc: int | None = None) -> np.ndarray:
    """The n ids of a block; raises ValueError where the checksum differs."""
    all64 = (1 << 64) - 1
    words16 = np.frombuffer(payload, ">u2").tolist()
    value, at = 0, 4
    for w in words16[:4]:
        value = value << 16 | w
    low, span = 0, all64

    def settle(c: int, f: int) -> None:
        nonlocal low, span, value, at
        low = (low + c * span) & all64
        span *= f
        while True:
            if (low ^ ((low + span) & all64)) >= 1 << 48:
                if span >= 1 << 32:
                    return
                span = -low & 0xFFFFFFFF
            value = (value << 16 | (words16[at] if at < len(words16) else 0)) & all64
            at += 1
            low, span = (low << 16) & all64, (span << 16) & all64

    out: list[int] = []
    begin = set(cuts(n))
    counts, sums, total = np.ones(size, np.int64), None, 0
    fresh: list[int] = []
    credit, later = np.zeros((_CLASSES, _SLOTS + 1), np.int64), np.zeros((_CLASSES, _SLOTS + 1), np.int64)
    seen: tuple[dict, dict] = ({}, {})  # of order 2 and 1: what followed each context, the latest first
    w: list = []
    for t in range(n):
        if t in begin:
            credit += later
            later[:] = 0
            w = _weights(credit).tolist()
            if fresh:
                counts += _STEP * np.bincount(fresh, minlength=size)
                fresh = []
            sums = np.cumsum(counts)
            total = int(sums[-1])
        keys = (tuple(out[-2:]) if t > 1 else None, out[-1] if t else None)
        two, one = seen[0].get(keys[0], []), seen[1].get(keys[1], [])
        said = [*two, *[-1] * (SLOTS2 - len(two)), *one, *[-1] * (SLOTS1 - len(one))]
        klass = (len(two) * (SLOTS1 + 1) + len(one)) * 8 + (len(two) > 1 and two[0] == two[1]) * 4 + (len(one) > 1 and one[0] == one[1]) * 2 + bool(two and one and two[0] == one[0])
        own = w[klass]
        span //= total << _MIX
        v = ((value - low) & all64) // span
        groups: dict[int, int] = {}
        for c, f in zip(said, own):
            if c >= 0:
                groups[c] = groups.get(c, 0) + f
        at_, x = 0, -1
        for c, f in groups.items():
            if v < (at_ + f) * total:
                x = c
                settle(at_ * total, f * total)
                break
            at_ += f
        if x < 0:
            f = own[-1]
            x = int(np.searchsorted(sums, (v - at_ * total) // f, side="right"))
            settle(at_ * total + int(sums[x] - counts[x]) * f, f * int(counts[x]))
            fresh.append(x)
            later[klass, _SLOTS] += _UNIT
        else:
            right = [i for i, c in enumerate(said) if c == x]
            later[klass, right] += _UNIT // len(right)
        for known, key, most in ((seen[0], keys[0], SLOTS2), (seen[1], keys[1], SLOTS1)):
            if key is not None:
                known[key] = [x, *known.get(key, [])[: most - 1]]
        out.append(x)
    got = np.array(out, np.uint16)
    if crc is not None and zlib.crc32(got.astype("<u2").tobytes()) != crc:
        raise ValueError("the block's checksum differs")
    return got


def write(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per block: (doc_ids, starts, lengths) of its parts, how many ids, their checksum, the coded bytes."""
    types = [pa.list_(pa.int64())] * 3 + [pa.int64()] * 3 + [pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        w = words(vocabulary)
        full: list[tuple[list, list, list, np.ndarray]] = []
        parts: tuple[list, list, list, list] = ([], [], [], [])
        room = block

        def close():
            nonlocal parts, room
            if parts[0]:
                full.append((*parts[:3], np.concatenate(parts[3]) if parts[3] else np.zeros(0, np.uint16)))
            parts, room = ([], [], [], []), block

        def emit():
            payloads = encode([x for *_, x in full], w.size)
            rows = [(d, s, n, len(x), zlib.crc32(x.astype("<u2").tobytes()), len(p), p) for (d, s, n, x), p in zip(full, payloads)]
            full.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in slices(batches, "t"):
            texts = b.column(1).to_pylist()
            for doc, text, ids in zip(b.column(0).to_pylist(), texts, w.many([t or "" for t in texts])):
                at = 0
                while True:
                    part = ids[at : at + room]
                    for p, v in zip(parts, (doc, at, -1 if text is None else len(part), part)):
                        p.append(v)
                    at, room = at + len(part), room - len(part)
                    if room <= 0 or len(parts[0]) >= block:
                        close()
                        if len(full) >= LANES:
                            yield emit()
                    if at >= len(ids):
                        break
        close()
        if full:
            yield emit()

    return pick(docs, k="doc_id", t="text").select(F.col("k").try_cast("long").alias("k"), "t").mapInArrow(run, SCHEMA)


def read(blocks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, ids) of each part, from the rows of write(); ids are null for a null text."""

    def run(batches):
        size = words(vocabulary).size
        for b in batches:
            cols: tuple[list, list, list] = ([], [], [])
            for docs, starts, lengths, n, crc, payload in zip(*(b.column(i).to_pylist() for i in range(6))):
                ids, at = decode(payload, n, size, crc).tolist(), 0
                for d, s, m in zip(docs, starts, lengths):
                    for c, v in zip(cols, (d, s, None if m < 0 else ids[at : at + m])):
                        c.append(v)
                    at += max(m, 0)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return blocks.select("doc_ids", "starts", "lengths", "n_ids", "crc", "payload").mapInArrow(run, "doc_id long, start long, ids array<int>")
