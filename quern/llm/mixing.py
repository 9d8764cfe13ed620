"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in hashed order, as a stream of characters that begins again where it ends (epoch 1,
2, ...), and the stream is cut into blocks of `block` characters, whatever the source's size: block i (from 0) is
characters i*block to (i+1)*block of the stream. With target weight w, block i is released at slot floor(i/w) and due
before slot ceil((i+1)/w); one block goes to each slot, of the released ones the one with the earliest deadline. Every
block then lies in its window, so at any slot each source is less than one block away from its target. A document
belongs to the block that its first character lies in, so in characters the blocks add the length of the documents at
their two edges.

Weights are whole numbers out of their sum (given or made ones times 2**40, rounded): windows are exact, however many
slots there are. The schedule is made in chunks of slots, by the executors. A chunk begins at a state that earliest
deadline first can go on from without a miss (of the sources owed part of a block, those due first have it), `lead`
slots ahead of its own; by then all blocks in which two such runs differ are due, so the chunk meets the state that the
chunk before it ends in. This is compared, and a chunk that began otherwise is made again from the true state. To the
driver comes one row for each source, and two states a chunk.

The mixture is as long as it takes for every document to be in it once, and sources that are short of their weight
by then go on with further epochs, so nothing is dropped and the weights hold throughout. A source that has no weight
among those given gets none and is left out.

Defined results: a null source is a source of its own; a null or empty text counts as one character; a
null doc_id is carried. Equal rows stay together in their block and are all kept. An empty table gives
an empty result. Extra columns are carried by mixed() and ignored by schedule().
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpoint, fresh, pick

BLOCK, ALPHA, BUCKET_ROWS, CHUNK = 1 << 18, 0.8, 50_000, 1 << 18


def shares(weights: list[float]) -> list[int]:
    """The weights as whole numbers, 1 at least."""
    whole = sum(weights)
    return [max(1, round(w / whole * (1 << 40))) for w in weights]


def owed(a: list[int], slot: int) -> list[int]:
    """How many blocks each source may have had before `slot`: what it is due, rounded down, and one more for
    those whose next block is due first, until there are `slot` in all."""
    total = sum(a)
    done = [slot * x // total for x in a]
    part = [s for s, x in enumerate(a) if slot * x % total]
    part.sort(key=lambda s: (-(-(done[s] + 1) * total // a[s]), s))
    for s in part[: slot - sum(done)]:
        done[s] += 1
    return done


def run(a: list[int], done: list[int], slots: int, keep: int = 0) -> tuple[np.ndarray, list[int]]:
    """The sources of `slots` slots by earliest deadline first, from a state (blocks that each source has had), and
    the state after; of the slots the first `keep` aren't returned."""
    total, done, slot = sum(a), list(done), sum(done)
    waiting = [(i * total // a[s], s) for s, i in enumerate(done)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    out = np.empty(slots - keep, np.int32)
    for k in range(slots):
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // a[s]), s))
        deadline, s = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        if k >= keep:
            out[k - keep] = s
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // a[s], s))
        slot += 1
    return out, done


def lead(a: list[int]) -> int:
    """So many slots before its own a chunk begins: the longest window, and one."""
    return -(-sum(a) // min(a)) + 1


def chunk(a: list[int], first: int, last: int, state: list[int] | None = None) -> tuple[list[int], np.ndarray, list[int]]:
    """(state at `first`, sources of the slots from there to `last`, state at `last`). state: where it is known."""
    if state is None:
        before = max(0, first - lead(a))
        _, state = run(a, owed(a, before), first - before, first - before)
    got, after = run(a, state, last - first)
    return state, got, after


_SLOTS = "k long, slot long, s int, number long, ahead array<long>, behind array<long>"


def _slots(spark, a: list[int], slots: int, size: int | None = None) -> DataFrame:
    """(slot, s, number): the source of each slot and the number of its block, as a table that is kept."""
    size = size or max(CHUNK, 2 * lead(a))
    names = [x.split()[0] for x in _SLOTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def made(known: dict):
        def go(batches):
            for b in batches:
                for k in b.column(0).to_pylist():
                    first, last = k * size, min((k + 1) * size, slots)
                    before, got, after = chunk(a, first, last, known.get(k))
                    number = np.empty(len(got), np.int64)
                    for s in range(len(a)):
                        own = np.flatnonzero(got == s)
                        number[own] = before[s] + np.arange(len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([k], [None], [None], [None], [before], [after]), types)], names=names)
                    n = len(got)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(np.arange(first, last)), pa.array(got), pa.array(number), pa.nulls(n, types[4]), pa.nulls(n, types[5])], names=names)

        return go

    chunks = -(-slots // size)
    parts: list[DataFrame] = []
    todo, known = list(range(chunks)), {}
    states: dict[int, tuple] = {}
    while todo:
        ids = spark.range(chunks, numPartitions=min(chunks, 10_000)) if len(todo) == chunks else spark.createDataFrame([(k,) for k in todo], "id long")
        got = checkpoint(spark, ids.mapInArrow(made(known), _SLOTS))
        parts = [p.where(~F.col("k").isin(todo)) for p in parts] + [got.where("slot is not null")]
        states |= {r.k: (r.ahead, r.behind) for r in got.where("slot is null").collect()}
        # each chunk but the first must begin where the one before it ends
        todo = [k for k in range(1, chunks) if states[k][0] != states[k - 1][1]]
        known = {k: states[k - 1][1] for k in todo}
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("slot", "s", "number")


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, source, sig, size): sig tells rows apart that share an id."""
    base = pick(docs, id="doc_id", source="source", text="text")
    return base.select(F.col("id").try_cast("long").alias("id"), F.col("source").cast("string"), F.xxhash64("id", "source", "text").alias("sig"), F.greatest(F.lit(1), F.length("text")).cast("long").alias("size"))


def _schedule(docs: DataFrame, weights, alpha: float, block: int, seed: int) -> tuple[DataFrame, int]:
    """(slot, start, source, block, epoch, id, sig, rows) of each occurrence; how many slots there are."""
    spark = docs.sparkSession
    keyed = checkpoint(spark, _keyed(docs).withColumn("h", F.xxhash64(F.lit(seed), "id", "sig")))
    stats = sorted(keyed.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    if weights is not None:
        stats = [r for r in stats if weights.get(r.source, 0) > 0]
    if not stats:
        none = F.lit(0).cast("long")
        return keyed.where("false").select(none.alias("slot"), none.alias("start"), "source", none.alias("block"), none.alias("epoch"), "id", "sig", none.alias("rows")), 0
    a = shares([weights[r.source] if weights is not None else r["size"] ** alpha for r in stats])
    slots = max(-(-(-(-r["size"] // block)) * sum(a) // x) for r, x in zip(stats, a))
    # a source has so many blocks at the end, or one more
    sources = spark.createDataFrame([(r.source, s, r["size"], (slots * x // sum(a) + 1) * block) for s, (r, x) in enumerate(zip(stats, a))], "s3 string, s int, whole long, end long")
    places = _slots(spark, a, slots).withColumnRenamed("s", "s4")
    bits = max(0, (max(r.n for r in stats) // BUCKET_ROWS).bit_length())
    keyed = keyed.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    same = [F.col("source"), F.col("bucket")]
    rows = keyed.repartition(*same).groupBy("source", "bucket", "h", "id", "sig").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    inside = Window.partitionBy(*same).orderBy("h", "id", "sig")
    rows = rows.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    starts = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("own"))
    starts = starts.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), (F.sum("own").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own")).alias("base"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).withColumn("at", F.col("base") + F.col("before")).select("source", "at", "id", "sig", "rows")
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s3")))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - 1 - F.col("at")) / F.col("whole")).cast("long"))))
    rows = rows.withColumn("start", F.col("at") + F.col("epoch") * F.col("whole")).withColumn("block", F.floor(F.col("start") / block).cast("long"))
    rows = rows.join(places, (F.col("s") == F.col("s4")) & (F.col("block") == F.col("number")))
    return rows.select("slot", "start", "source", "block", "epoch", "id", "sig", "rows"), slots


def schedule(docs: DataFrame, weights: dict | None = None, *, alpha: float = ALPHA, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(slot, start, source, block, epoch, doc_id): by (slot, start) the order of the mixture; start: the
    characters before the document in its source's stream, over all epochs; block: the stream's block."""
    got, _ = _schedule(docs, weights, alpha, block, seed)
    return got.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select("slot", "start", "source", "block", "epoch", F.col("id").alias("doc_id"))


def mixed(docs: DataFrame, weights: dict | None = None, *, alpha: float = ALPHA, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """docs in the order of the mixture, over partitions and within them; later epochs are further rows."""
    got, slots = _schedule(docs, weights, alpha, block, seed)
    a, b, slot, start = (fresh(docs, x) for x in ("mix_id", "mix_sig", "mix_slot", "mix_start"))
    got = got.select(F.col("id").alias(a), F.col("sig").alias(b), F.col("slot").alias(slot), F.col("start").alias(start))
    have = {c: F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string") for c in ("doc_id", "source", "text")}
    key, sig = fresh(docs, "own_id"), fresh(docs, "own_sig")
    own = docs.withColumn(key, have["doc_id"].try_cast("long")).withColumn(sig, F.xxhash64(have["doc_id"], have["source"], have["text"]))
    rows = own.join(got, own[key].eqNullSafe(got[a]) & (own[sig] == got[b]))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.floor(F.col(slot) * parts / max(1, slots)).cast("int")
    rows = rows.repartitionById(parts, part) if hasattr(rows, "repartitionById") else rows.repartitionByRange(parts, slot, start)
    return rows.sortWithinPartitions(slot, start).select(*[F.col(f"`{c}`") for c in docs.columns])
