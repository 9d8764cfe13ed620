"""The inverted n-gram index: build, look up, update, status.

    <root>/state-<n>.json           the states; the highest n counts
    <root>/after-<n>                who may write the state that follows n
    <root>/gen-<id>/files           the base's manifest
    <root>/gen-<id>/postings        (gram, shard, n, keys, counts, low, high, paths, origins, often, often_n)
    <root>/over-<id>/...            an overlay, with its changes

A shard is some megabytes of neighbouring texts. Its n-grams are packed into rows by the first 16 bits of their keys
(column gram), so building shuffles no texts, and Spark and Parquet handle a row for some thirty n-grams as four strings
of bytes: `keys` has the other 32 bits of each key, `counts` how many texts have it less 1, `low` and `high` the bytes of
the steps from one of these texts' places in the shard to the next; all are little-endian, and n counts the places. A
lookup scans with gram pushed down to the pages, meets by shard, and ends in places that the shard's head row
(gram -1) turns into paths. `often` has
the n-grams of over an eighth of a shard's texts, `often_n` of how many, for a head: what isn't among them is in an
eighth of those texts at most, so few n-grams can be in a quarter of all, and only those are counted.

A writer adds the state that follows the one it began from, or fails with Conflict; nothing is held while it works,
so one that dies blocks nobody. root may be any path that Spark can write to. The index only narrows down what is
searched: results equal those of a scan.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ngram
from quern.operators import search as se
from quern.plans import boolplan
from quern.sources.shared import Folder, checkpoint

VERSION, STALE_SECONDS = 2, 24 * 3600
#: How rows of postings are laid out; an index of another layout is built anew by update().
LAYOUT = 3
#: Bytes of text to a shard, and to a task where texts lie so unevenly that they are spread first (a row group is read by one task).
SHARD, SPREAD = 8 << 20, 64 << 20
#: Candidates up to FEW go into the scan as a list; n-grams in more than 1 / COMMON of the files (and in LEAST_COMMON at least) aren't looked up.
FEW, COMMON, LEAST_COMMON = 2000, 4, 64
#: Above so many different beginnings of keys all rows are read.
BEGINNINGS = 4096
HEAD = -1
#: Up to MANY paths are looked for in a corpus by a broadcast set of their hashes (some 24 MB).
MANY = 1 << 20
#: Places that go from Python to Spark at once.
ROWS = 1 << 18
_POSTINGS = "gram long, shard long, n int, keys binary, counts binary, low binary, high binary, paths array<string>, origins array<string>, often array<long>, often_n array<int>"
_PACKED = ("keys", "counts", "low", "high")
#: Rows to a page, as a lookup reads whole pages. Packed bytes have no use for dictionaries.
_OPTIONS = {"parquet.writer.version": "v2", "parquet.page.row.count.limit": "1000", "compression": "zstd", "parquet.compression.codec.zstd.level": "1"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("gram", *_PACKED)}
CLAIM_SECONDS = 60


class Conflict(RuntimeError):
    """Another writer was faster; nothing was changed."""


def _texts(batches, most: int | None = None):
    """Slices of about `most` (SHARD) bytes of the batches' binary second column, null rows left out; slices run over batches."""
    kept, total, most = [], 0, most or SHARD
    for b in batches:
        size = np.diff(np.frombuffer(b.column(1).cast(pa.large_binary()).buffers()[1], np.int64)[b.column(1).offset :][: b.num_rows + 1]) if b.num_rows else np.zeros(0, np.int64)
        begin = 0
        for i, n in enumerate(size.tolist()):
            if total and (total + n > most or sum(len(x) for x in kept) + i - begin >= ngram.MOST_ROWS):
                yield [*kept, b.slice(begin, i - begin)]
                kept, total, begin = [], 0, i
            total += n
        if begin < b.num_rows:
            kept.append(b.slice(begin))
    if kept:
        yield kept


def extract(files: DataFrame) -> DataFrame:
    """(file_id, gram): the distinct n-grams of each text of (file_id, content)."""

    def run(batches):
        for part in _texts(batches, SHARD // 8):  # no row is shared by texts, so slices may be small
            t = pa.Table.from_batches(part).combine_chunks()
            both, ids = ngram.codes(t.column(1).combine_chunks()), t.column(0).to_numpy()
            for at in range(0, len(both), ROWS):
                key, row = ngram.parted(both[at : at + ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row])], names=["gram", "file_id"])

    return files.select("file_id", F.col("content").cast("binary").alias("content")).where("content is not null").mapInArrow(run, "gram long, file_id long")


def _shards(batches):
    """(file_path, content, origin) to rows of _POSTINGS: per shard a head and a row for each beginning of keys."""
    names = [x.split()[0] for x in _POSTINGS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    for part in _texts(batches):
        t = pa.Table.from_batches(part).combine_chunks()
        paths, origins = t.column(0).to_pylist(), t.column(2).to_pylist()
        both = ngram.codes(t.column(1).combine_chunks())
        shard = xxhash.xxh3_64_intdigest(both.data, xxhash.xxh3_64_intdigest("\0".join(x or "" for x in paths).encode())) - (1 << 63)
        edge = ngram.edges(both)
        often_n = np.diff(edge)
        often = np.flatnonzero(often_n > len(paths) / (2 * COMMON))
        often, often_n = ngram.parted(both[edge[often]])[0], often_n[often]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([HEAD], [shard], [len(paths)], *[[None]] * 4, [paths], [origins], [often], [often_n]), types)], names=names)
        begin = np.searchsorted(both[edge[:-1]], np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))  # each beginning's n-grams
        begin = np.append(np.unique(begin), len(edge) - 1)
        begin = begin[: np.searchsorted(begin, len(edge) - 1) + 1]
        s = 0
        while s < len(begin) - 1:  # rows of so many places at most, or one row
            e = max(s + 1, int(np.searchsorted(edge[begin], edge[begin[s]] + ROWS, "right")) - 1)
            own, at = begin[s : e + 1] - begin[s], edge[begin[s] : begin[e] + 1] - edge[begin[s]]
            words = both[edge[begin[s]] : edge[begin[e]]].astype("<u8", copy=False).view("<u2").reshape(-1, 4)  # place, key, key, its beginning
            step = words[:, 0].copy()
            step[1:] -= words[:-1, 0]
            step[at[:-1]] = words[at[:-1], 0]
            low, high = step.view(np.uint8)[::2], step.view(np.uint8)[1::2]
            packed = [_binary(x, o) for x, o in ((words[at[:-1], 1:3], own * 4), ((np.diff(at) - 1).astype("<u2"), own * 2), (low, at[own]), (high, at[own]))]
            none = [pa.nulls(e - s, k) for k in types[7:]]
            yield pa.RecordBatch.from_arrays([pa.array(words[at[own[:-1]], 3].astype(np.int64)), pa.array(np.full(e - s, shard)), pa.array(np.diff(at[own]).astype(np.int32)), *packed, *none], names=names)
            s = e


def _binary(x: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _bytes(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What the values of a binary column without nulls hold, one after the other, and how many numbers are in each."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    kind = np.dtype(kind)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // kind.itemsize


def lists(rows: DataFrame, keys: list[int] | None = None, docs: bool = False) -> DataFrame:
    """(gram, shard, n[, docs]): a row for each n-gram of postings, or of these keys only: how many texts of the shard have it, and their places."""
    asked = None if keys is None else np.unique(np.array(keys, np.int64))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, per = _bytes(b.column(2), "<u4")
            gram = np.repeat(b.column(0).to_numpy(), per) << 32 | key
            n = _bytes(b.column(3), "<u2")[0].astype(np.int64) + 1
            hit = np.arange(len(gram)) if asked is None else np.flatnonzero(np.isin(gram, asked))
            out = [pa.array(gram[hit]), pa.array(np.repeat(b.column(1).to_numpy(), per)[hit]), pa.array(n[hit].astype(np.int32))]
            if docs:
                low, high = (_bytes(b.column(i), "u1")[0] for i in (4, 5))
                stop = np.cumsum(n)
                steps = (low[z - m : z] | high[z - m : z].astype(np.int32) << 8 for z, m in zip(stop[hit].tolist(), n[hit].tolist()))
                ends = np.concatenate([[0], np.cumsum(n[hit])]).astype(np.int32)
                places = np.concatenate([np.zeros(0, np.int32), *[np.cumsum(x, dtype=np.int32) for x in steps]])
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(places)))
            yield pa.RecordBatch.from_arrays(out, names=["gram", "shard", "n", "docs"][: len(out)])

    return rows.select("gram", "shard", *_PACKED[: 4 if docs else 2]).mapInArrow(run, "gram long, shard long, n int" + ", docs array<int>" * docs)


def manifest(corpus: DataFrame) -> DataFrame:
    """(file_id, file_path, size, mtime, digest, skipped, origin, content): one row per path; ids are hashes of paths.
    Nulls are no files. Binary content with a NUL early on is skipped, as a scan skips it; texts of any size aren't."""
    mtime = F.col("mtime").cast("long") if "mtime" in corpus.columns else F.lit(None).cast("long")
    origin = F.col("origin") if "origin" in corpus.columns else F.lit(None).cast("string")
    binary = dict(corpus.dtypes)["content"] == "binary"
    content = F.col("content").cast("binary")
    return corpus.where(content.isNotNull()).select(
        F.xxhash64("file_path").alias("file_id"), "file_path", F.octet_length(content).cast("long").alias("size"), mtime.alias("mtime"), F.xxhash64(content).alias("digest"),
        (se.is_binary(content) if binary else F.lit(False)).alias("skipped"), origin.alias("origin"), content.alias("content"),
    )


def _spread(corpus: DataFrame, total: int, most: int) -> DataFrame:
    """Where one task would have more than twice its share of the bytes, as of a table in one row group, the texts are
    spread by their paths over all cores and over tasks of about SPREAD; elsewhere they stay where they lie."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return corpus.repartition(max(cores, -(-total // SPREAD)), "file_path") if most > SHARD and most * cores > 2 * total else corpus


@contextmanager
def _small_batches(spark: SparkSession):
    """Texts go to Python in batches of a shard's size, as a worker holds a shard's n-grams beside its batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(min(SHARD, spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _write(corpus: DataFrame, folder: str) -> dict:
    """Writes files and postings; how many files, and the common n-grams."""
    spark = corpus.sparkSession
    manifest(corpus).drop("content").withColumn("task", F.spark_partition_id()).write.parquet(f"{folder}/files")
    tasks = spark.read.parquet(f"{folder}/files").where(~F.col("skipped")).groupBy("task").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    files, total, most = (x or 0 for x in tasks.agg(F.sum("n"), F.sum("size"), F.max("size")).first())
    with _small_batches(spark):
        manifest(_spread(corpus, total, most)).where(~F.col("skipped")).select("file_path", "content", "origin").mapInArrow(_shards, _POSTINGS).write.options(**_OPTIONS).parquet(f"{folder}/postings")
    return {"folder": folder.rsplit("/", 1)[-1], "files": files, "common": _common(spark.read.parquet(f"{folder}/postings"), max(LEAST_COMMON, files // COMMON))}


def _common(rows: DataFrame, least: int) -> list[int]:
    """The n-grams of more than `least` texts, a quarter of all at least. Those that can be are few, as the texts of the
    shards where they are often have some eighth of all texts' number of them, whatever the shards' sizes."""
    heads = rows.where(F.col("gram") == HEAD)
    files = heads.agg(F.sum("n")).first()[0] or 0
    if files <= least:
        return []
    often = heads.select("n", F.explode(F.arrays_zip("often", "often_n")).alias("x")).groupBy("x.often").agg(F.sum("x.often_n").alias("some"), F.sum("n").alias("of"))
    may = [r.often for r in often.where(F.col("some") + (files - F.col("of")) / (2 * COMMON) > least).select("often").collect()]
    if not may:
        return []
    first = sorted({k >> 32 for k in may})
    counts = lists(rows.where(F.col("gram").isin(first) if len(first) <= BEGINNINGS else F.col("gram") != HEAD), may).groupBy("gram").agg(F.sum("n").alias("n"))
    return sorted(r.gram for r in counts.where(F.col("n") > least).collect())


def current(root: str, spark: SparkSession | None = None) -> dict | None:
    """The state that counts, or None where there is no index."""
    folder = Folder(spark or SparkSession.active(), root)
    states = [x for x in folder.names() if x.startswith("state-")]
    return json.loads(folder.read(max(states))) if states else None


def _commit(spark: SparkSession, root: str, state: dict, before: dict | None) -> dict:
    folder, parent = Folder(spark, root), before["number"] if before else 0
    claim = f"after-{parent:012d}"
    if not folder.claim(claim):
        newest = current(root, spark)
        if (newest["number"] if newest else 0) != parent or folder.age(claim) < CLAIM_SECONDS:
            raise Conflict(f"another writer follows state {parent} of {root}")
        folder.delete(claim)  # its writer died between claim and state
        if not folder.claim(claim):
            raise Conflict(f"another writer follows state {parent} of {root}")
    newest = current(root, spark)
    if (newest["number"] if newest else 0) != parent:
        raise Conflict(f"another writer follows state {parent} of {root}")
    state["number"] = parent + 1
    folder.write(f"state-{parent + 1:012d}.json", json.dumps(state))
    return state


def build(corpus: DataFrame, root: str, commit: str | None = None) -> dict:
    spark, before = corpus.sparkSession, current(root, corpus.sparkSession)
    base = _write(corpus, f"{root}/gen-{uuid.uuid4().hex}")
    return _commit(spark, root, {"version": VERSION, "layout": LAYOUT, "time": time.time(), "commit": commit, "base": base, "overlay": None, "tombstones": 0}, before)


def branch(spark: SparkSession, root: str, to: str) -> dict:
    """A second index on the base of the first, of which nothing is copied; the first one's base must stay."""
    state = current(root, spark)
    base = state["base"] | {"folder": state["base"]["folder"] if "/" in state["base"]["folder"] else f"{root}/{state['base']['folder']}"}
    return _commit(spark, to, state | {"base": base, "overlay": None, "tombstones": 0}, current(to, spark))


def _folder(root: str, part: dict) -> str:
    return part["folder"] if "/" in part["folder"] else f"{root}/{part['folder']}"


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change): added, changed or deleted. Files of equal size whose times are known and equal are the
    same; where a time isn't known, digests decide."""
    a = old.select("file_path", F.struct("size", "mtime", "digest").alias("was"))
    b = new.select("file_path", F.struct("size", "mtime", "digest").alias("is"))
    timed = F.col("was.mtime").isNotNull() & F.col("is.mtime").isNotNull()
    same = (F.col("was.size") == F.col("is.size")) & F.when(timed, F.col("was.mtime") == F.col("is.mtime")).otherwise(F.coalesce(F.col("was.digest") == F.col("is.digest"), F.lit(False)))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~same, "changed")
    return a.join(b, "file_path", "full_outer").select("file_path", kind.alias("change")).where("change is not null")


def _near(corpus: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """The rows of these n paths, perhaps with some others (of equal hashes, or all where the paths are more than MANY):
    no text is shuffled."""
    if n > MANY:
        return corpus
    ids = paths.select(F.xxhash64("file_path").alias("quern__id")).distinct()
    return corpus.join(F.broadcast(ids), F.xxhash64(corpus["file_path"]) == ids["quern__id"], "left_semi")


def update(corpus: DataFrame, root: str, listing: DataFrame | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None, commit: str | None = None) -> dict:
    """Makes the overlay anew from what differs from the base; without a base builds one.

    With `listing` (file_path, size, mtime) no text is read to find what differs, and `fetch` reads the texts of the
    paths that do. Otherwise the corpus is compared: by its columns `size` and `mtime` where it has both (no text is
    read then, either), else by digests of all texts."""
    spark = corpus.sparkSession
    before = current(root, spark)
    if before is None or (before.get("version"), before.get("layout")) != (VERSION, LAYOUT):
        return build(corpus, root, commit)
    if listing is None and {"size", "mtime"} <= set(corpus.columns):
        listing = corpus.where("content is not null").select("file_path", "size", "mtime")
    base = spark.read.parquet(f"{_folder(root, before['base'])}/files")
    if listing is None:
        new = manifest(corpus)
    else:
        new = listing.select("file_path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"), F.lit(None).cast("long").alias("digest"))
    folder = f"over-{uuid.uuid4().hex}"
    changes(base, new).write.parquet(f"{root}/{folder}/changes")
    diff = spark.read.parquet(f"{root}/{folder}/changes")
    counts = dict(diff.groupBy("change").count().collect())
    state = before | {"time": time.time(), "overlay": None, "tombstones": 0, "commit": commit or before.get("commit")}
    if counts:
        state["tombstones"] = counts.get("changed", 0) + counts.get("deleted", 0)
        fresh = diff.where("change != 'deleted'").select("file_path")
        near = lambda: _near(corpus, fresh, counts.get("changed", 0) + counts.get("added", 0))
        state["overlay"] = _write(fetch(fresh) if fetch else near().join(fresh, "file_path", "left_semi"), f"{root}/{folder}")
    return _commit(spark, root, state, before)


def vacuum(spark: SparkSession, root: str, older_than: float = 3600) -> list[str]:
    """Deletes states, claims and folders that the current state doesn't need and that are `older_than` seconds old
    (readers and writers may still be at work on younger ones); their names."""
    state, folder = current(root, spark), Folder(spark, root)
    if state is None:
        return []
    own = {f"state-{state['number']:012d}.json", f"after-{state['number']:012d}", state["base"]["folder"], (state["overlay"] or {}).get("folder")}
    gone = [n for n, at in folder.names().items() if n.startswith(("state-", "after-", "gen-", "over-", ".state-")) and n not in own and time.time() - at > older_than]
    for n in gone:
        folder.delete(n)
    return sorted(gone)


def age_label(seconds: float) -> str:
    s = int(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}m" if s < 3600 else f"{s // 3600}h" if s < 86400 else f"{s // 86400}d"


def status(spark: SparkSession, root: str) -> DataFrame:
    s = current(root, spark)
    if s is None:
        raise FileNotFoundError(f"no index at {root}")
    over = s["overlay"] or {"files": 0}
    row = (s["version"], s["base"]["files"], over["files"], s["tombstones"], age_label(time.time() - s["time"]), (s["commit"] or "")[:7] or None)
    out = spark.createDataFrame([row], "version int, files long, overlay_files long, tombstones long, age string, commit string")
    return out.select("version", "files", _grams(spark, root, s["base"]).alias("grams"), "overlay_files", _grams(spark, root, s["overlay"]).alias("overlay_grams"), "tombstones", "age", "commit")


def _grams(spark: SparkSession, root: str, part: dict | None) -> Column:
    """How many distinct n-grams a part has, counted where the column is asked for."""
    if not part:
        return F.lit(0).cast("long")
    return lists(postings(spark, root, part).where(F.col("gram") != HEAD)).agg(F.count_distinct("gram")).scalar()


def postings(spark: SparkSession, root: str, part: dict) -> DataFrame:
    return spark.read.parquet(f"{_folder(root, part)}/postings")


def ids_for(rows: DataFrame, plan: boolplan.Plan) -> DataFrame:
    """(shard, docs): the places in each shard that the plan admits: one scan of the n-grams asked for and one aggregate."""
    keys = plan.keys()
    first = list(dict.fromkeys(k >> 32 for k in keys))
    asked = F.col("gram").isin(first)
    if len(first) > 10:  # longer lists are pushed down as a range
        asked = F.col("gram") == first[0]
        for k in first[1:]:
            asked |= F.col("gram") == k
    none = F.array().cast("array<int>")
    found = lists(rows.where(asked), keys, docs=True).groupBy("shard").agg(*[F.coalesce(F.first(F.when(F.col("gram") == k, F.col("docs")), ignorenulls=True), none).alias(f"g{i}") for i, k in enumerate(keys)])

    def column(p: boolplan.Plan):
        if p.op == "lookup":
            return F.col(f"g{keys.index(p.key)}")
        out = column(p.parts[0])
        for x in p.parts[1:]:
            out = F.array_intersect(out, column(x)) if p.op == "and" else F.array_union(out, column(x))
        return out

    return found.select("shard", column(plan).alias("docs")).where(F.size("docs") > 0)


def _state(spark: SparkSession, root: str) -> dict:
    s = current(root, spark)
    if s is None:
        raise FileNotFoundError(f"no index at {root}")
    if s.get("layout") != LAYOUT:
        raise ValueError(f"the index at {root} has another layout; update() builds it anew")
    if time.time() - s["time"] > STALE_SECONDS:
        warnings.warn("the index is older than a day; update it", stacklevel=3)
    return s


def candidates(spark: SparkSession, root: str, plan: boolplan.Plan) -> DataFrame:
    """(file_path, origin) of live files that the plan admits, from the base and the overlay."""
    return _candidates(spark, root, plan, _state(spark, root))


def _candidates(spark: SparkSession, root: str, plan: boolplan.Plan, s: dict) -> DataFrame:
    def part(p: dict) -> DataFrame:
        rows = postings(spark, root, p)
        heads = rows.where(F.col("gram") == HEAD).select(F.col("shard").alias("own"), "paths", "origins")
        sure = plan.without(frozenset(p["common"]))
        if sure.op == "scan":
            return heads.select(F.explode(F.arrays_zip("paths", "origins")).alias("x")).select(F.col("x.paths").alias("file_path"), F.col("x.origins").alias("origin"))
        got = ids_for(rows, sure).join(heads, F.col("shard") == F.col("own"))
        at = F.explode(F.transform("docs", lambda i: F.struct(F.element_at("paths", i + 1).alias("file_path"), F.element_at("origins", i + 1).alias("origin"))))
        return got.select(at.alias("x")).select("x.file_path", "x.origin")

    base = part(s["base"])
    if s["overlay"]:
        dead = spark.read.parquet(f"{_folder(root, s['overlay'])}/changes").where("change != 'added'").select("file_path")
        base = base.join(dead, "file_path", "left_anti").select("file_path", "origin").unionByName(part(s["overlay"]))
    return base


def search(corpus: DataFrame, root: str, pattern: str | list[str], options: se.SearchOptions | None = None, auto_index: bool = False, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As search.search, on the texts that the index leaves over. auto_index builds a missing index.

    `fetch` reads the texts of a DataFrame of paths (file trees). Otherwise up to FEW candidates go into the scan of
    the corpus as a list, which comes before the pattern and prunes what `file_path` and `origin` let the source prune
    (origin: a column of the corpus that names the file of a row, i.e. _metadata.file_path); more are joined by a set of
    their hashes, and beyond MANY all texts are searched, as shuffling them would take longer than the pattern."""
    o = options or se.SearchOptions()
    spark = corpus.sparkSession
    if auto_index and current(root, spark) is None:
        build(corpus, root)
    _, regex = se.effective(pattern, o)
    state = _state(spark, root)
    plan = boolplan.build(regex)
    if all(plan.without(frozenset(p["common"])).op == "scan" for p in (state["base"], state["overlay"]) if p):
        return se.search(corpus, pattern, o)
    found = _candidates(spark, root, plan, state)
    if fetch:
        return se.search(fetch(found), pattern, o)
    found = checkpoint(spark, found)
    few = found.limit(FEW + 1).agg(F.collect_list(F.struct("file_path", "origin")).alias("rows")).collect()[0].rows
    if len(few) <= FEW:
        left = corpus.where(F.col("file_path").isin([r.file_path for r in few]) if few else F.lit(False))
        if few and "origin" in corpus.columns and all(r.origin for r in few):
            left = left.where(F.col("origin").isin(sorted({r.origin for r in few})))
        return se.search(left, pattern, o)
    n = found.count()
    if n > MANY:
        return se.search(corpus, pattern, o)
    # a number that the optimiser can't move keeps the pattern behind the join
    left = _near(corpus, found, n).withColumn("quern__at", F.monotonically_increasing_id())
    return se.search(left.where("quern__at >= 0"), pattern, o)
