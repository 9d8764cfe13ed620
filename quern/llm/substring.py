"""Substring dedup by hashed units: lines, and pieces of lines.

Normalised (lower case, white space single), every line is a unit, and every line of `unit_words` words or more is cut into
pieces, which are units of their own kind: a piece ends at a word whose mark (a hash of the word) is the least among the
`unit_words` - 1 words on either side in the line. Where a cut falls depends on the words around it alone, so a passage
inside of another line has the same pieces there, but for those at its edges. Pieces have `unit_words` words at least, but
for rests at a line's start and end.

Digests are grouped over the whole corpus and ranked by (doc_id, start); all but the first ranked occurrence are repeats.
Removed are

* every line that is a repeat, of any length;
* pieces that are repeats and follow each other, over line ends too, where they have `least_words` words or more
  together. Rests join such a run where they are repeats, but don't begin or end it (a line under `unit_words` words that is
  a repeat does). Shorter runs stay, as pieces of few words repeat by chance.

What is removed and has nothing between is one span. A span covers repeats only: any word that is none ends it.

How it runs: texts are cut for whole batches at once. In each batch the first occurrence of a digest stands for it; the
others are repeats whatever comes of the rest and are spread, so a digest that is everywhere comes to its task once for
each batch, not once for each occurrence. What is a repeat, and the first occurrences that the others ask for, are written
(checkpoint), and the others joined with those.

Defined results: offsets are characters from 0 in the original text. Null and empty texts have no
units. A null doc_id (or one that is no number) ranks last and is reported as null. Rows with the same doc_id and text are
one document (their spans are reported once). An empty table gives an empty result. Extra columns are not read. A line of
white space is no unit. Characters whose lower case is longer or shorter in UTF-8 are left as they are. In scripts without
blanks each character is a word.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import text
from quern.llm.common import checkpoint, pick, slices

U = np.uint64
UNIT_WORDS, LEAST_WORDS = 4, 20
_NONE = np.int64(1 << 62)
#: d: digest; p: start and length; q: number of the (first) piece and words; r: hash of the text, n + 1, whether it stands for
#: its digest in its batch and isn't alone there. n: 0 a piece, else a line of so many pieces, -1 a line that has none but is one.
_UNITS = "d long, doc_id long, p long, q long, r long"
_SPANS = "doc_id long, start int, length int, words int, kept_id long, kept_start int"
_UNEVEN = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and len(c.lower().encode()) != len(c.encode()))
_UNEVEN_RE = re.compile(f"[{re.escape(_UNEVEN)}]")


def lowered(column: pa.Array) -> pa.Array:
    """In lower case, byte by byte as long as before."""
    low = pc.utf8_lower(column)
    odd = np.flatnonzero(pc.match_substring_regex(column, f"[{_UNEVEN}]").fill_null(False).to_numpy(zero_copy_only=False))
    if not len(odd):
        return low
    out = low.to_pylist()
    for i in odd.tolist():
        t = column[i].as_py()
        parts = _UNEVEN_RE.split(t)
        kept = _UNEVEN_RE.findall(t)
        out[i] = "".join(pc.utf8_lower(pa.scalar(p)).as_py() + c for p, c in zip(parts, [*kept, ""]))
    return pa.array(out, pa.large_string())


def _marks(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, known: dict) -> np.ndarray:
    """The first 60 bits of the MD5 of each word; each different word is hashed once."""
    different, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    data = raw.tobytes()
    if len(known) > 1 << 20:
        known.clear()
    out = np.empty(len(different), np.int64)
    for i, (h, s, e) in enumerate(zip(different.tolist(), start[at].tolist(), end[at].tolist())):
        m = known.get(h)
        if m is None:
            m = known[h] = int(hashlib.md5(data[s:e]).hexdigest()[:15], 16)
        out[i] = m
    return out[which]


def units(column: pa.Array, unit_words: int = UNIT_WORDS, known: dict | None = None) -> dict[str, np.ndarray]:
    """The units of each text: row, d, k, n, start, stop (characters) and words, pieces and short lines first, then lines."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    low = lowered(column)
    raw, offsets = text.flat(low)
    s, e = text.solid(raw, offsets)
    if not len(s):
        return {c: np.zeros(0, np.int64) for c in ("row", "d", "k", "n", "start", "stop", "words")}
    h = text.hashes(raw, s, e, 1)
    mark = _marks(raw, s, e, h, {} if known is None else known)
    row = np.searchsorted(offsets, s, side="right") - 1
    line = np.searchsorted(np.flatnonzero(raw == 10), s) + row  # lines of different texts differ
    n, gap = len(s), unit_words - 1
    new = np.ones(n, bool)
    new[1:] = line[1:] != line[:-1]
    last = np.ones(n, bool)
    last[:-1] = new[1:]
    number = np.cumsum(new) - 1
    at = np.arange(n) + gap * (number + 1)
    padded = np.full(n + gap * (number[-1] + 2), _NONE)
    padded[at] = mark
    left, right = np.full(n, _NONE), np.full(n, _NONE)
    for j in range(1, gap + 1):
        left, right = np.minimum(left, padded[at - j]), np.minimum(right, padded[at + j])
    cut = (mark < left) & (mark <= right)
    begin_line = np.flatnonzero(new)
    end_line = np.flatnonzero(last)
    length = end_line - begin_line + 1
    short = np.repeat(length < unit_words, length)
    piece_start, piece_end = new.copy(), last.copy()
    piece_start[1:] |= cut[:-1] & ~short[1:]
    piece_end |= cut & ~short
    a, b = np.flatnonzero(piece_start), np.flatnonzero(piece_end)
    # characters: continuation bytes don't count
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    base = chars[offsets[:-1]]
    up, down = text.powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * up[:n], out=sums[1:])

    def digest(i, j, salt):
        return text.mix((sums[j + 1] - sums[i]) * down[i] + text.mix((j - i + 1).astype(U) + U(salt))).view(np.int64)

    per_row = np.searchsorted(row[a], np.arange(len(column)))
    k = np.arange(len(a)) - per_row[row[a]]
    whole = short[a]
    some = length >= unit_words
    la, lb = begin_line[some], end_line[some]
    first_piece = np.searchsorted(a, la)
    i, j = np.concatenate([a, la]), np.concatenate([b, lb])
    out = {
        "row": row[i], "d": np.concatenate([np.where(whole, digest(a, b, 1 << 40), digest(a, b, 0)), digest(la, lb, 1 << 40)]),
        "k": np.concatenate([k, k[first_piece]]), "n": np.concatenate([np.where(whole, -1, 0), np.searchsorted(a, lb, side="right") - first_piece]),
        "start": chars[s[i]] - base[row[i]], "stop": chars[e[j]] - base[row[i]], "words": j - i + 1,
    }
    return out


def _cut(unit_words: int):
    names = [x.split()[0] for x in _UNITS.split(", ")]

    def run(batches):
        known: dict = {}
        for b in slices(batches, "t"):
            ids = b.column(0)
            u = units(b.column(1), unit_words, known)
            row = u["row"]
            t = (text.hashes(*_whole(b.column(1))) >> U(32)).astype(np.int64)[row]
            null = ~ids.is_valid().to_numpy(zero_copy_only=False)[row]
            doc = ids.fill_null(0).to_numpy()[row]
            order = np.lexsort((t, u["start"], doc, null, u["d"]))
            d = u["d"][order]
            lead = np.ones(len(d), bool)
            lead[1:] = d[1:] != d[:-1]
            alone = lead.copy()
            alone[:-1] &= lead[1:]
            first, many = np.empty(len(d), bool), np.empty(len(d), bool)
            first[order], many[order] = lead, ~alone
            cols = [u["start"] << 32 | u["stop"] - u["start"], u["k"] << 32 | u["words"], (t - (1 << 31)) << 32 | (u["n"] + 1) << 2 | first << 1 | many]
            yield pa.RecordBatch.from_arrays([pa.array(u["d"]), pa.array(doc, mask=null), *map(pa.array, cols)], names=names)

    return run


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = text.flat(column)
    return raw, offsets[:-1], offsets[1:]


def spans(doc: np.ndarray, x: dict[str, np.ndarray], least_words: int = LEAST_WORDS, unit_words: int = UNIT_WORDS) -> dict[str, np.ndarray]:
    """The spans to remove from repeats (k, n, start, stop, words, kept_null, kept_id, kept_start) of documents. doc: the
    number of each row's document, rising; rows are in order of k in it, a line's before the pieces'."""
    line = x["n"] > 0
    own = np.flatnonzero(~line)
    p = {c: v[own] for c, v in x.items()}
    n, pd_ = len(own), doc[own]
    whole = p["n"] < 0
    head = np.full(n, -1)  # the row of the line that begins with a piece
    lines = np.flatnonzero(line)
    if len(lines):
        key = pd_ * (1 << 32) + p["k"]
        at = np.searchsorted(key, doc[lines] * (1 << 32) + x["k"][lines])
        ok = (at < n) & (key[np.minimum(at, n - 1)] == doc[lines] * (1 << 32) + x["k"][lines]) if n else np.zeros(len(lines), bool)
        at, lines = at[ok], lines[ok]  # every piece of a repeated line is a repeat
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + x["n"][lines], -1)
        whole |= np.cumsum(steps[:-1]) > 0
        head[at] = lines
    if not n:
        return {c: np.zeros(0, np.int64) for c in ("doc", "start", "length", "words", "kept_null", "kept_id", "kept_start")}
    new = np.ones(n, bool)
    new[1:] = (pd_[1:] != pd_[:-1]) | (p["k"][1:] != p["k"][:-1] + 1)
    run = np.cumsum(new) - 1
    edge = np.append(np.flatnonzero(new), n)
    solid = whole | (p["words"] >= unit_words)
    i = np.arange(n)
    low = np.minimum.reduceat(np.where(solid, i, n), edge[:-1])
    high = np.maximum.reduceat(np.where(solid, i, -1), edge[:-1])
    total = np.concatenate([[0], np.cumsum(p["words"])])
    words = np.where(high >= low, total[np.maximum(high, 0) + 1] - total[np.minimum(low, n - 1)], 0)
    kept = whole | ((words >= least_words)[run] & (i >= low[run]) & (i <= high[run]))
    j = np.flatnonzero(kept)
    if not len(j):
        return {c: np.zeros(0, np.int64) for c in ("doc", "start", "length", "words", "kept_null", "kept_id", "kept_start")}
    fresh = np.ones(len(j), bool)
    fresh[1:] = new[j[1:]] | (j[1:] != j[:-1] + 1)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(j)) - 1
    a, b = j[begin], j[end]
    source = np.where(head[a] >= 0, head[a], own[a])
    return {"doc": pd_[a], "start": p["start"][a], "length": p["stop"][b] - p["start"][a], "words": total[b + 1] - total[a], "kept_null": x["kept_null"][source], "kept_id": x["kept_id"][source], "kept_start": x["kept_start"][source]}


def _merge(least_words: int, unit_words: int):
    """Rows (doc_id, p, q, r, kept_id, kept_start) sorted by document, k and kind, in which a document may run over batches."""
    names = [x.split()[0] for x in _SPANS.split(", ")]
    low = (1 << 32) - 1

    def made(b):
        ids, kept = b.column(0), b.column(4)
        null, value = ~ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        p, q, r = (b.column(i).to_numpy() for i in (1, 2, 3))
        t, k, n = r >> 32, q >> 32, ((r & low) >> 2) - 1
        same = (value[1:] == value[:-1]) & (t[1:] == t[:-1]) & (null[1:] == null[:-1])
        new, own = np.zeros(len(t), bool), np.ones(len(t), bool)
        new[1:] = ~same
        own[1:] = ~(same & (k[1:] == k[:-1]) & (n[1:] == n[:-1]))  # rows with one id and text are one document
        x = {"k": k, "n": n, "start": p >> 32, "stop": (p >> 32) + (p & low), "words": q & low, "kept_start": b.column(5).to_numpy()}
        x |= {"kept_null": ~kept.is_valid().to_numpy(zero_copy_only=False), "kept_id": kept.fill_null(0).to_numpy()}
        doc = np.cumsum(new)
        got = spans(doc[own], {c: v[own] for c, v in x.items()}, least_words, unit_words)
        first = np.searchsorted(doc, got["doc"])
        ints = [pa.array(got[c].astype(np.int32)) for c in ("start", "length", "words")]
        cols = [pa.array(value[first], mask=null[first]), *ints, pa.array(got["kept_id"].astype(np.int64), mask=got["kept_null"].astype(bool)), pa.array(got["kept_start"].astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            doc, t = b.column(0), b.column(3).to_numpy() >> 32
            last = np.asarray(pc.fill_null(pc.equal(doc, doc[-1]), False)) if doc[-1].is_valid else ~doc.is_valid().to_numpy(zero_copy_only=False)
            last &= t == t[-1]
            cut = 0 if last.all() else b.num_rows - int(np.argmin(last[::-1]))
            if cut:
                yield made(pa.Table.from_batches([*kept, b.slice(0, cut)]).combine_chunks().to_batches()[0])
                kept = []
            kept.append(b.slice(cut))
        if kept:
            yield made(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return run


def repeats(docs: DataFrame, unit_words: int = UNIT_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, length, words, kept_id, kept_start): each span to remove; kept_*: where the first
    occurrence of its first unit stays."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = pick(docs, k="doc_id", t="text").select(F.expr("try_cast(k as bigint)").alias("k"), "t").where("t is not null and t != ''")
    stands = F.col("r").bitwiseAND(F.lit(2)) == 2
    cut = base.mapInArrow(_cut(unit_words), _UNITS).withColumn("apart", F.when(stands, 0).otherwise(F.xxhash64("doc_id", "p", "r")))
    start, t = F.shiftright("p", 32), F.shiftright("r", 32)
    place = F.struct("doc_id", start.alias("start"), t.alias("t"))
    one = Window.partitionBy("d", "apart")
    rank = one.orderBy(F.col("doc_id").asc_nulls_last(), start, t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumn("f", F.first(place).over(rank)).withColumn("asked", F.max(F.col("r").bitwiseAND(F.lit(1))).over(one) == 1).withColumn("is_first", F.col("f").eqNullSafe(place))
    own = checkpoint(spark, own.where(~stands | ~F.col("is_first") | F.col("asked")).select("d", "doc_id", "p", "q", "r", "is_first", "f"))
    columns = ["doc_id", "p", "q", "r", F.col("f.doc_id").alias("kept_id"), F.col("f.start").alias("kept_start")]
    firsts = own.where(stands & F.col("is_first")).select(F.col("d").alias("d2"), "f").dropDuplicates(["d2"])
    others = own.where(~stands).drop("f").join(firsts, F.col("d") == F.col("d2")).where(~F.col("f").eqNullSafe(place))
    rows = own.where(stands & ~F.col("is_first")).select(*columns).union(others.select(*columns))
    rows = rows.repartition(parts, "doc_id", t).sortWithinPartitions("doc_id", t, F.shiftright("q", 32), F.desc(F.col("r").bitwiseAND(F.lit((1 << 32) - 1))))
    return rows.mapInArrow(_merge(least_words, unit_words), _SPANS)


#: The same in DuckDB's SQL, for texts whose blanks are ASCII, in scripts with blanks, and whose ids are unique.
SQL = f"""
with lines as (
  select doc_id, generate_subscripts(p, 1) as ln, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null and text <> '')
), based as (
  select *, sum(length(line) + 1) over (partition by doc_id order by ln) - length(line) - 1 as base from lines
), cut as (
  select doc_id, ln, base, generate_subscripts(p, 1) as i, unnest(p) as piece from (select *, regexp_extract_all(line, '\\s*\\S+') as p from based)
), words as (
  select doc_id, ln, i, lower(regexp_extract(piece, '\\S+')) as word, length(regexp_extract(piece, '\\S+')) as size, base + sum(length(piece)) over (partition by doc_id, ln order by i) as stop from cut
), marked as (
  select *, count(*) over (partition by doc_id, ln) as n, ('0x' || substr(md5(word), 1, 15))::bigint as mark from words
), cuts as (
  select *, coalesce(mark < min(mark) over (partition by doc_id, ln order by i rows between {UNIT_WORDS - 1} preceding and 1 preceding), true)
    and coalesce(mark <= min(mark) over (partition by doc_id, ln order by i rows between 1 following and {UNIT_WORDS - 1} following), true) and n >= {UNIT_WORDS} as is_cut from marked
), numbered as (
  select *, coalesce(sum(is_cut::int) over (partition by doc_id, ln order by i rows between unbounded preceding and 1 preceding), 0) as pn from cuts
), pieces as (
  select doc_id, ln, pn, n < {UNIT_WORDS} as short, min(stop - size) as start, max(stop) as stop, count(*) as words, string_agg(word, ' ' order by i) as txt from numbered group by all
), whole as (
  select doc_id, ln, min(stop - size) as start, string_agg(word, ' ' order by i) as txt from numbered group by all
), ranked as (
  select doc_id, ln, row_number() over (partition by txt order by doc_id, start) > 1 as again, first_value(doc_id) over (partition by txt order by doc_id, start) as kept_id, first_value(start) over (partition by txt order by doc_id, start) as kept_start from whole
), joined as (
  select p.*, row_number() over (partition by p.doc_id order by p.start) as k,
    not p.short and row_number() over (partition by p.txt, p.short order by p.doc_id, p.start) > 1 as piece_again,
    first_value(p.doc_id) over (partition by p.txt, p.short order by p.doc_id, p.start) as piece_id, first_value(p.start) over (partition by p.txt, p.short order by p.doc_id, p.start) as piece_start,
    r.again, r.kept_id as line_id, r.kept_start as line_start from pieces p join ranked r using (doc_id, ln)
), good as (
  select *, k - row_number() over (partition by doc_id order by k) as run, again or words >= {UNIT_WORDS} as solid from joined where piece_again or again
), edges as (
  select *, min(case when solid then k end) over (partition by doc_id, run) as low, max(case when solid then k end) over (partition by doc_id, run) as high from good
), kept as (
  select * from (select *, sum(case when k between low and high then words else 0 end) over (partition by doc_id, run) as total from edges) where again or (total >= {LEAST_WORDS} and k between low and high)
), islands as (
  select *, k - row_number() over (partition by doc_id order by k) as island from kept
)
select doc_id, min(start)::int as start, (max(stop) - min(start))::int as length, sum(words)::int as words,
  arg_min(case when again and pn = 0 then line_id else piece_id end, k)::bigint as kept_id, arg_min(case when again and pn = 0 then line_start else piece_start end, k)::int as kept_start
from islands group by doc_id, island
"""
