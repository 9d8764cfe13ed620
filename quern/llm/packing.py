"""Variable-capacity best-fit packing.

A document has as many tokens as its text has UTF-8 bytes, and one for its end (byte-level ids), or, with the path of a
`vocabulary`, as many as op9 writes ids for it, and one. Longer documents are cut into pieces of the largest permitted
length. Pieces are spread over groups of about `group_rows`, and each group is packed by itself: longest first, each
piece into the bin with the least room that holds it. Where none does, a bin is opened of the permitted length that
costs least per token that can be expected in it (its own piece and what is left to pack). A group is packed under each
opening rule (that one, and each length as the least to open); the cheapest whole stays. Finally every
bin is cut down to the least permitted length that holds its contents. A sequence of c tokens
costs fixed + c + c * c / quadratic (attention).

Groups: rows of files are spread by a hash of their place (file and row), so that no value of a row, null or frequent,
makes a group large; rows without a place by their id and text. With `in_order` a group is a run of neighbouring rows
of one file, files in the order of their numbers, so that bins follow an order that was written (a mixture) and groups
can be read one after the other. Rows that share a doc_id in a group (epochs, or repeated rows) never share a bin.

Defined results: null and empty texts have no pieces. A null doc_id is carried, and is no id that rows share. Equal rows
are packed each. Ties go to the lower doc_id, start, and place. An empty table gives no bins. Extra columns are not read;
doc_id must be a number, or text that reads as one (else null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pick, slices

CAPACITIES, GROUP_ROWS, FIXED, QUADRATIC = (2048, 4096, 8192, 16384, 32768), 20_000, 64, 65536
_OUT = "bin long, capacity int, used int, place int, doc_id long, start long, length int"
_PLACED = f"{_OUT}, file string, row long"


def cost(c: float, fixed: float = FIXED, quadratic: float = QUADRATIC) -> float:
    return fixed + c + c * c / quadratic


def _fit(lengths: list[int], caps: tuple[int, ...], least: int | None, twins: list | None = None) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, used by bin, opened size by bin). least: the least size to open, None for the least-cost rule.
    twins: for each piece what it may share no bin with, None for nothing."""
    costs = {c: cost(c) for c in caps}
    rooms: dict[int, list[int]] = {}  # room left -> bins, the first opened last
    mask = 0
    where, used, size = [], [], []
    left = sum(lengths)
    smallest = lengths[-1] if lengths else 0
    apart: dict = {}
    for i, n in enumerate(lengths):
        above = mask >> n
        twin = twins[i] if twins else None
        taken = apart.setdefault(twin, set()) if twin is not None else ()
        b = -1
        while above:
            room = n + (above & -above).bit_length() - 1
            bins = rooms[room]
            k = next((k for k in range(len(bins) - 1, -1, -1) if bins[k] not in taken), -1) if taken else len(bins) - 1
            if k >= 0:
                b = bins.pop(k)
                if not bins:
                    mask ^= 1 << room
                break
            above &= above - 1
        if b < 0:
            fits = [c for c in caps if c >= n and (least is None or c >= least)] or [caps[-1]]
            if least is None:
                rest = left - n
                c = min(fits, key=lambda c: (costs[c] / (min(c, n + rest) if c - n >= smallest else n), c))
            else:
                c = fits[0]
            b, room = len(used), c
            used.append(0)
            size.append(c)
        used[b] += n
        left -= n
        room -= n
        if room:
            rooms.setdefault(room, []).append(b)
            mask |= 1 << room
        if twin is not None:
            taken.add(b)
        where.append(b)
    return where, used, size


def pack(lengths: list[int], caps: tuple[int, ...] = CAPACITIES, twins: list | None = None) -> tuple[list[int], list[int], list[int], list[int]]:
    """For lengths in falling order: (bin, place) of each, (used, capacity) of each bin, of the cheapest rule."""
    caps = tuple(sorted(caps))
    best = None
    for least in (None, *caps):
        where, used, _ = _fit(lengths, caps, least, twins)
        down = [next(c for c in caps if c >= u) for u in used]
        total = sum(map(cost, down))
        if best is None or total < best[0]:
            best = (total, where, used, down)
    _, where, used, down = best
    fill = [0] * len(used)
    place = []
    for n, b in zip(lengths, where):
        place.append(fill[b])
        fill[b] += n
    return where, place, used, down


def _packed(caps: tuple[int, ...], placed: bool):
    names = [x.split()[0] for x in (_PLACED if placed else _OUT).split(", ")]

    def done(group, ids, start, length, row, file):
        # an id that several rows have: their pieces keep apart
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy()
        order = np.lexsort((row, values))
        v, r = values[order], row[order]
        twice = np.isin(values, v[1:][(v[1:] == v[:-1]) & (r[1:] != r[:-1])]) & known
        twins = [v if t else None for v, t in zip(values.tolist(), twice.tolist())] if twice.any() else None
        where, place, used, down = pack(length.tolist(), caps, twins)
        where = np.array(where, np.int64)
        cols = [
            pa.array(where + (np.int64(group) << 24)), pa.array(np.array(down, np.int32)[where]), pa.array(np.array(used, np.int32)[where]),
            pa.array(np.array(place, np.int32)), ids, pa.array(start), pa.array(length),
        ]
        return pa.RecordBatch.from_arrays([*cols, file, pa.array(row)] if placed else cols, names=names)

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for s, e in zip(cuts, cuts[1:]):
                if kept and kept[-1].column(0)[0].as_py() != g[s]:
                    yield one(kept)
                    kept = []
                kept.append(b.slice(s, e - s))
        if kept:
            yield one(kept)

    def one(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        col = lambda i: t.column(i).combine_chunks()
        return done(parts[0].column(0)[0].as_py(), col(1), col(2).to_numpy(), col(3).to_numpy().astype(np.int32), col(4).to_numpy(), col(5) if placed else None)

    return run


def _placed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(id, t, file, row), and whether docs are read from files, whose rows have a place. A row without one has the
    hash of its text for it."""
    try:
        both = docs.select("*", F.col("_metadata.file_path").alias("quern__file"), F.col("_metadata.row_index").alias("quern__row"))
    except AnalysisException:
        return pick(docs, id="doc_id", t="text").select("id", "t", F.lit(None).cast("string").alias("file"), F.xxhash64("t").alias("row")), False
    return pick(both, id="doc_id", t="text", file="quern__file", row="quern__row"), True


def _counted(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(id, n, file, row): n by the ids of a vocabulary."""
    from quern.llm.binary import words

    def run(batches):
        w = words(vocabulary)
        for b in slices(batches, "t"):
            n = [len(x) for x in w.many([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), b.column(3)], names=["id", "n", "file", "row"])

    return rows.select("id", "t", "file", "row").mapInArrow(run, "id long, n long, file string, row long")


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = GROUP_ROWS, *, in_order: bool = False, vocabulary: str | None = None) -> DataFrame:
    """(bin, capacity, used, place, doc_id, start, length): each piece and where it lies in its bin, in tokens. With
    in_order also (file, row), the row that a piece is of; bins follow each other as their groups do. Rows without a
    place have no order and are spread."""
    most, tasks = max(capacities), max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base, placed = _placed(docs)
    base = base.withColumn("id", F.expr("try_cast(id as bigint)"))
    base = _counted(base, vocabulary) if vocabulary else base.select("id", F.octet_length("t").cast("long").alias("n"), "file", "row")
    base = base.where("n > 0")
    parts = base.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"), F.lit(most).cast("long"))))
    if in_order and placed:
        number = F.coalesce(F.expr(r"try_cast(regexp_extract(file, 'part-([0-9]+)[^/]*$', 1) as bigint)"), F.pmod(F.xxhash64("file"), F.lit(1 << 20)))
        group = number * (1 << 18) + F.floor(F.col("row") / group_rows)
    else:
        pieces = base.agg(F.coalesce(F.sum(F.ceil((F.col("n") + 1) / most)), F.lit(0))).first()[0]
        groups = max(1, round(pieces / group_rows))
        group, tasks = F.pmod(F.xxhash64("file", "row", F.lit(None) if placed else F.col("id"), "start"), F.lit(groups)), min(groups, tasks)
    parts = parts.select(group.cast("long").alias("g"), "id", "start", F.least(F.lit(most), F.col("n") + 1 - F.col("start")).cast("int").alias("length"), "row", *(["file"] if in_order else []))
    spread = parts.repartition(tasks, "g").sortWithinPartitions("g", F.desc("length"), "id", "start", "row")
    return spread.mapInArrow(_packed(tuple(sorted(capacities)), in_order), _PLACED if in_order else _OUT)
