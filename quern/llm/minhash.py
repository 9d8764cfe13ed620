"""Near-duplicate search: banded MinHash, verified by odd sketches.

A text is lower-cased and cut into words (runs of letters and digits; in scripts without blanks, as Chinese, Japanese or
Thai, each character is a word); its set is that of its `shingle`-word runs. `bands * rows` MinHash samples of the set give band keys, and are
folded into an odd sketch: a bitmap of `bits` parities, one toggled per sample. For two sets with
Jaccard J the XOR of the bitmaps has n/2 * (1 - exp(-4k(1-J)/n)) ones on average, so its population
count estimates J (k samples, n bits).

1. one pass over the texts makes (id, digest, band keys, sketch), written once as a checkpoint;
2. equal digests are joined to their lowest id, which alone goes on (huge groups of exact copies cost one row each);
3. keys that many ids have are told first, by counts of a sample of the ids, combined before the shuffle (a key's count
   decides where its ids are compared, not whether); the others are shuffled as (key, id) and give candidate sets; of keys
   with the same ids one is kept;
4. in each set of up to some `HOT` ids all pairs that aren't linked already are verified by sketch, so no partner is capped;
5. a larger set is spread: each id is compared with the set's lowest one and those in its block; when the components
   of all links so far are known, blocks of ids are compared with each other, but for pairs of blocks that are of
   one component. Nothing is left out, and no task sees more than two blocks of a set at once;
6. connected components (large-star / small-star); the lowest doc_id of a component stays.

What step 5 costs: nothing more than one comparison an id where a large set is of copies; for ids that share a band and
aren't alike it is all their pairs, spread over the tasks.

Defined results: null texts and texts without a word are never compared and stay; so do rows with a
null doc_id. Rows that share a doc_id count as one document, of which keep_one() keeps one row (the
least by hash of its text). Ties can't arise: the lowest id wins. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import text
from quern.llm.common import checkpoint, fresh, pick, slices
from quern.llm.text import mix

U = np.uint64
HOT, WIDE, SAMPLE = 1 << 16, 4096, 4096


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    bands: int = 50
    rows: int = 4
    bits: int = 1024
    threshold: float = 0.5
    seed: int = 20240229

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text with the end appended), for a whole column at once."""
    raw, offsets = text.flat(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    starts, ends = text.letters(raw, offsets)
    return text.hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` words, first of each text with the end appended); a shorter text is one run."""
    counts = np.diff(first)
    runs = np.where(counts == 0, 0, np.maximum(1, counts - size + 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], runs)
    ends = np.repeat(first[1:], runs)
    total = np.zeros(len(at), U)
    for j in range(size):
        k = at + j
        ok = k < ends
        total = total * U(0x100000001B3) + np.where(ok, hashes[np.minimum(k, max(0, len(hashes) - 1))], U(0)) if len(hashes) else total
    return mix(total + U(size)), begin


def signatures(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether it has words, two 64-bit digests, MinHash samples, odd sketches) of each text."""
    hashes, first = words(column)
    runs, begin = shingles(hashes, first, p.shingle)
    n, k = len(column), p.samples
    rng = np.random.default_rng(p.seed)
    a = (rng.integers(0, 1 << 32, k, np.uint32) | np.uint32(1))[:, None]
    b = rng.integers(0, 1 << 32, k, np.uint32)[:, None]
    x = (runs >> U(32)).astype(np.uint32)
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    step = 512
    buffer = np.empty((k, step), np.uint32)
    for i in range(n):
        s, e = begin[i], begin[i + 1]
        low = out[i]
        for j in range(s, e, step):
            part = x[j : min(e, j + step)]
            v = buffer[:, : len(part)]
            np.multiply(a, part, out=v)
            v += b
            np.minimum(low, v.min(axis=1), out=low)
    has = np.diff(first) > 0
    place = np.arange(len(hashes), dtype=U) - np.repeat(first[:-1], np.diff(first)).astype(U)
    digests = np.zeros((2, n), U)
    full = np.flatnonzero(has)
    for j, salt in enumerate((0x51ED270B35AE8F01, 0xB492B66FBE98F273)):
        v = mix(hashes ^ mix(place + U(salt)))
        if len(full):
            digests[j][full] = np.add.reduceat(v, first[:-1][full])
    which = mix(out.astype(U) + (np.arange(k, dtype=U) << U(32))) % U(p.bits)
    flat = (which + (np.arange(n, dtype=U) * U(p.bits))[:, None]).astype(np.int64)
    sketch = np.packbits((np.bincount(flat.ravel(), minlength=n * p.bits) & 1).astype(np.uint8).reshape(n, p.bits), axis=1)
    return has, digests, out, sketch


def band_keys(samples: np.ndarray, p: Params) -> np.ndarray:
    x = samples.astype(U).reshape(len(samples), p.bands, p.rows)
    key = np.broadcast_to(mix(np.arange(p.bands, dtype=U) + U(77)), x.shape[:2]).copy()
    for j in range(p.rows):
        key = mix(key + x[:, :, j])
    return key.view(np.int64)


def estimate(ones: np.ndarray, p: Params) -> np.ndarray:
    """Jaccard from the population count of the XOR of two odd sketches."""
    left = np.maximum(1 - 2 * ones / p.bits, 1e-9)
    return 1 + p.bits / (4 * p.samples) * np.log(left)


def sign(docs: DataFrame, p: Params) -> DataFrame:
    """(id, d1, d2, keys, sketch) of each document that has an id and a word."""

    def run(batches):
        for b in slices(batches, "t", 1 << 20):
            has, digests, samples, sketch = signatures(b.column(1), p)
            keep = np.flatnonzero(has)
            keys = band_keys(samples[keep], p)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(keep)), pa.array(digests[0][keep].view(np.int64)), pa.array(digests[1][keep].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * p.bands), pa.array(keys.ravel())),
                    pa.array([r.tobytes() for r in sketch[keep]], pa.binary()),
                ],
                names=["id", "d1", "d2", "keys", "sketch"],
            )

    base = pick(docs, id="doc_id", t="text").select(F.expr("try_cast(id as bigint)").alias("id"), "t").where("id is not null and t is not null")
    return base.mapInArrow(run, "id long, d1 long, d2 long, keys array<long>, sketch binary")


def _sets(batches):
    """Sorted (key, id) rows to the sets of ids that share a key, as (h1, h2, ids); a key may run over batches."""
    rest_key, rest_id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(key, ids):
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[fresh], ids[fresh]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        keep = size > 1
        if not keep.any():
            return None
        rows = np.repeat(keep, size)
        ids, size = ids[rows], size[keep]
        start = np.concatenate([[0], np.cumsum(size)])
        u = ids.view(U)
        h = [np.add.reduceat(mix(u + U(s)), start[:-1]).view(np.int64) for s in (0x1F123BB5, 0x7C0E3A9D)]
        return pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids))], names=["h1", "h2", "ids"])

    for b in batches:
        key, ids = np.concatenate([rest_key, b.column(0).to_numpy()]), np.concatenate([rest_id, b.column(1).to_numpy()])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        rest_key, rest_id = key[cut:], ids[cut:]
        if (r := out(key[:cut], ids[:cut])) is not None:
            yield r
    if (r := out(rest_key, rest_id)) is not None:
        yield r


def link(sketches: np.ndarray, p: Params) -> np.ndarray:
    """For n sketches (n x words): the lowest member linked to each, where every pair at the threshold
    is linked."""
    n = len(sketches)
    root = np.arange(n)
    for i in range(n):
        like = estimate(np.bitwise_count(sketches ^ sketches[i]).sum(axis=1, dtype=np.int64), p) >= p.threshold
        like[i] = True
        roots = np.unique(root[like])
        root[np.isin(root, roots)] = roots[0]
    return root


def _link_large(sketches: np.ndarray, p: Params) -> np.ndarray:
    """link() in two steps: leaders against all, then members of different components among themselves."""
    n = len(sketches)
    root = np.full(n, -1)
    leaders = np.zeros(n, bool)
    for i in range(n):
        if root[i] >= 0:
            continue
        leaders[i], root[i] = True, i
        like = estimate(np.bitwise_count(sketches ^ sketches[i]).sum(axis=1, dtype=np.int64), p) >= p.threshold
        like[i] = True
        old = np.unique(root[like & (root >= 0)])
        root[np.isin(root, old)] = old[0]
        root[like] = old[0]
    for i in np.flatnonzero(~leaders):
        if (root == root[0]).all():
            break
        other = np.flatnonzero((root != root[i]) & ~leaders)
        if len(other):
            like = other[estimate(np.bitwise_count(sketches[other] ^ sketches[i]).sum(axis=1, dtype=np.int64), p) >= p.threshold]
            roots = np.unique(np.append(root[like], root[i]))
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return root


def _verify(p: Params):
    """Rows (set, block, id, sketch), sorted by set and block: edges (a, b) from each member to the lowest one linked to it."""

    def pairs(first, second, words):
        return estimate(np.bitwise_count(words[first] ^ words[second]).sum(axis=1, dtype=np.int64), p) >= p.threshold

    def edges(set_of, ids, words):
        begin = np.flatnonzero(np.concatenate([[True], (set_of[1:] != set_of[:-1]).any(axis=1)]))
        size = np.diff(np.append(begin, len(ids)))
        two = begin[size == 2]
        ok = pairs(two, two + 1, words)
        a, b = [ids[two + 1][ok]], [ids[two][ok]]
        for s, n in zip(begin[size > 2], size[size > 2]):
            root = (link if n <= 24 else _link_large)(words[s : s + n], p)
            moved = root != np.arange(n)
            own = ids[s : s + n]
            a.append(own[moved])
            b.append(own[root[moved]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    def run(batches):
        kept = None
        for x in batches:
            if not x.num_rows:
                continue
            col = x.column(3)
            words = np.frombuffer(b"".join(col.to_pylist()), U).reshape(x.num_rows, -1)
            part = (np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()], 1), x.column(2).to_numpy(), words)
            if kept is not None:
                part = tuple(np.concatenate([k, v]) for k, v in zip(kept, part))
            cut = int(np.flatnonzero((part[0] == part[0][-1]).all(axis=1))[0])
            if cut:
                yield edges(*(v[:cut] for v in part))
            kept = tuple(v[cut:] for v in part)
        if kept is not None:
            yield edges(*kept)

    return run


def _across(p: Params):
    """Rows (set, one, two, side, id, root, sketch), sorted by (set, one, two): edges between the roots of ids of block one
    and block two that are alike (side 0 and 1; a block with itself has both sides in one row, side 2)."""

    def edges(side, roots, words):
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        known = {}

        def top(x):
            while (y := known.get(x, x)) != x:
                x = y
            return x

        out = []
        r, w = roots[right], words[right]
        for i in left.tolist():
            other = np.flatnonzero(r != roots[i])
            if not len(other):
                continue
            like = other[estimate(np.bitwise_count(w[other] ^ words[i]).sum(axis=1, dtype=np.int64), p) >= p.threshold]
            for x in np.unique(r[like]).tolist():
                a, b = top(int(roots[i])), top(x)
                if a != b:
                    known[max(a, b)] = min(a, b)
                    out.append((max(a, b), min(a, b)))
        u, v = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches):
        kept = None
        for x in batches:
            if not x.num_rows:
                continue
            words = np.frombuffer(b"".join(x.column(6).to_pylist()), U).reshape(x.num_rows, -1)
            part = (np.stack([x.column(k).to_numpy() for k in (0, 1, 2)], 1), x.column(3).to_numpy(), x.column(5).to_numpy(), words)
            if kept is not None:
                part = tuple(np.concatenate([k, v]) for k, v in zip(kept, part))
            begin = np.flatnonzero(np.concatenate([[True], (part[0][1:] != part[0][:-1]).any(axis=1)]))
            for s, e in zip(begin, begin[1:]):
                yield edges(*(v[s:e] for v in part[1:]))
            kept = tuple(v[begin[-1] :] for v in part)
        if kept is not None:
            yield edges(*kept[1:])

    return run


def _different(keys: DataFrame) -> DataFrame:
    """(key, n) of band keys and how many ids they have; of keys with the same ids one."""
    # ids may repeat under a key where rows share a doc_id: a sum and an exclusive or with the count tell sets apart
    by_key = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("a"), F.sum(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 31))).alias("b"))
    return by_key.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key", "n")


def _large(hot: DataFrame, p: Params, links: DataFrame) -> DataFrame:
    """(u, v): links inside of large sets, from (key, n, id, sketch). links: those of the other sets."""
    spark = hot.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = checkpoint(spark, hot)
    least = hot.groupBy("key").agg(F.min(F.struct("id", "sketch")).alias("low"))
    star = hot.join(least, "key").where("id != low.id")

    @F.pandas_udf(T.BooleanType())
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        w = [np.frombuffer(b"".join(s), U).reshape(len(s), -1) for s in (x, y)]
        return pd.Series(estimate(np.bitwise_count(w[0] ^ w[1]).sum(axis=1, dtype=np.int64), p) >= p.threshold)

    star = star.where(alike("sketch", "low.sketch")).select(F.col("id").alias("u"), F.col("low.id").alias("v"))
    blocks = hot.select("key", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / WIDE)).alias("block"), "id", "sketch")
    inner = blocks.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "id").mapInArrow(_verify(p), "u long, v long")
    links = checkpoint(spark, links.union(star).union(inner).distinct())
    roots = components(spark, links).select(F.col("id").alias("own"), "root")
    hot = hot.join(roots, F.col("id") == F.col("own"), "left").select("key", "id", "sketch", F.coalesce("root", "id").alias("root"))
    sizes = hot.groupBy("key", "root").agg(F.count("*").alias("c"))
    several = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.sum("c").alias("n")).where("roots > 1")
    sizes = sizes.join(several, "key")
    # a component that fills blocks has blocks of its own, which aren't compared with each other
    hot = checkpoint(spark, hot.join(sizes, ["key", "root"]).withColumn("whole", F.col("c") * 2 > WIDE).withColumn(
        "block", F.when(F.col("whole"), F.xxhash64("root", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / WIDE)))).otherwise(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("root"), F.ceil(F.col("n") / WIDE))))
    ).select("key", "block", "whole", "id", "root", "sketch"))
    some = hot.groupBy("key", "block").agg(F.first("whole").alias("whole"), F.min("root").alias("root"))
    one = some.select("key", F.col("block").alias("one"), F.col("whole").alias("w1"), F.col("root").alias("r1"))
    two = some.select("key", F.col("block").alias("two"), F.col("whole").alias("w2"), F.col("root").alias("r2"))
    pairs = one.join(two, "key").where("one <= two and not (w1 and w2 and r1 = r2)").select("key", "one", "two")
    rows = hot.select("key", "block", "id", "root", "sketch")
    left = pairs.join(rows.withColumnRenamed("block", "one"), ["key", "one"]).select("key", "one", "two", F.when(F.col("one") == F.col("two"), 2).otherwise(0).alias("side"), "id", "root", "sketch")
    right = pairs.where("one < two").join(rows.withColumnRenamed("block", "two"), ["key", "two"]).select("key", "one", "two", F.lit(1).alias("side"), "id", "root", "sketch")
    found = left.union(right).repartition(parts, "key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(_across(p), "u long, v long")
    return links.union(found)


def components(spark, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, root): the lowest id of each connected component, for every id but the roots, from edges
    (u, v), u > v. Alternates large-star and small-star, cut by a checkpoint each round."""
    edges = checkpoint(spark, edges.distinct())
    known = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if state[0] == 0 or state == known:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        known = state
        both = edges.union(edges.select("v", "u"))  # large-star: neighbours above u go to the lowest neighbour
        w = Window.partitionBy("u")
        large = both.select("u", "v", F.least("u", F.min("v").over(w)).alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = F.min("v").over(w)  # small-star: u and its lower neighbours go to the lowest of them
        small = large.select("u", "v", low.alias("m"))
        edges = checkpoint(spark, small.select("u", F.col("m").alias("v")).union(small.select(F.col("v"), F.col("m"))).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, kept_id, exact): each document to remove, and the one that stays for it. exact: the words
    are the same."""
    return _near(docs, p)[0]


def _near(docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    signed = checkpoint(spark, sign(docs, p))
    digests = signed.groupBy("id", "d1", "d2").agg(F.count("*").alias("rows"))
    first = F.min("id").over(Window.partitionBy("d1", "d2"))
    copies = digests.select("id", first.alias("rep")).where("id != rep").distinct()
    alone = signed.join(copies.select("id").distinct(), "id", "left_anti")
    keys = alone.select(F.explode("keys").alias("key"), "id")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sketches = alone.groupBy("id").agg(F.min("sketch").alias("sketch"))
    # keys of some HOT ids and more, told by one id of SAMPLE; one that is missed is a set like the others
    seen = keys.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("key").count()
    hot = checkpoint(spark, seen.where(F.col("count") * SAMPLE >= HOT * 0.75).select("key"))
    is_hot = hot.limit(1).count() > 0
    rest = keys.join(hot, "key", "left_anti") if is_hot else keys
    sets = rest.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(_sets, "h1 long, h2 long, ids array<long>")
    sets = sets.groupBy("h1", "h2").agg(F.first("ids").alias("ids"))
    placed = sets.select("h1", "h2", F.explode("ids").alias("id")).join(sketches, "id").select("h1", "h2", "id", "sketch")
    near = placed.repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2", "id").mapInArrow(_verify(p), "u long, v long")
    if is_hot:
        own = keys.join(hot, "key")
        near = _large(own.join(_different(own), "key").distinct().join(sketches, "id").select("key", "n", "id", "sketch"), p, near)
    # one document that is a copy of several others (rows that share a doc_id) links them
    twice = copies.groupBy("id").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.collect_set("rep").alias("reps")).where("n > 1")
    near = near.union(twice.select(F.explode("reps").alias("u"), F.col("low").alias("v")).where("u > v"))
    roots = components(spark, near)
    rep = copies.groupBy("id").agg(F.min("rep").alias("rep"))
    exact = rep.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"), F.col("root").isNull().alias("exact"))
    own = roots.join(rep.select("id"), "id", "left_anti").select("id", "root", F.lit(False).alias("exact"))
    removed = exact.union(own).where("id != root").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_id"), "exact")
    return removed, digests


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without near duplicates; all columns stay as they are. Rows whose doc_id is null, or no number, stay."""
    removed, digests = _near(docs, p)
    gone, row, own = (fresh(docs, x) for x in ("gone", "row", "own"))
    ids = F.expr("try_cast(doc_id as bigint)") if "doc_id" in docs.columns else F.lit(None).cast("long")
    left = docs.withColumn(own, ids).join(removed.select(F.col("doc_id").alias(gone)), F.col(own) == F.col(gone), "left_anti")
    # ids that several rows have are few and looked for alone: null ids and the rest are not shuffled
    repeated = digests.groupBy("id").agg(F.sum("rows").alias("n")).where("n > 1").select(F.col("id").alias(gone))
    if not repeated.limit(1).count():
        return left.drop(own)
    several = left.join(repeated, F.col(own) == F.col(gone), "left_semi")
    order = Window.partitionBy(own).orderBy(F.xxhash64("text"), F.md5("text"))
    once = several.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
    rest = left.join(repeated, F.col(own) == F.col(gone), "left_anti")
    return rest.union(once).drop(own)
