"""Line search over a corpus DataFrame (file_path, content and what else it has).

Everything is columns: the text is split, lines are matched by rlike, offsets come from the matched
prefix's bytes. content may be a string or binary; binary that has a NUL in its first 8,192 bytes is
skipped, and bytes that aren't UTF-8 show as U+FFFD; offsets are always those of the bytes in the file.

While a text that isn't UTF-8 is worked on, each stray byte stands in it as one private character (the first of
a broken sequence at U+10FF00 + byte, others at U+10FE00 + byte), so that nothing is lost and offsets follow by
counting. Such rows alone pass a Python function; the source is scanned once.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import regex as rx
from quern.functions.glob import glob_regex

SNIFF = 8192
MAX_FILESIZE = 10_485_760


@dataclass(frozen=True)
class SearchOptions:
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    glob: str | None = None
    file_type: str | None = None
    max_count: int | None = None
    context: int = 0
    max_filesize: int | None = None  # bytes; file trees have a limit of their own where they are read


def effective(pattern: str | list[str], o: SearchOptions) -> tuple[str, rx.Regex]:
    """The combined pattern and what it was read as."""
    one = rx.combine([pattern] if isinstance(pattern, str) else list(pattern), o.fixed)
    folded = o.ignore_case or (o.smart_case and not any(c.isupper() for c in one))
    return one, rx.parse(one, folded)


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, SNIFF), F.lit(b"\x00"))


def size_filter(df: DataFrame, limit: int = MAX_FILESIZE) -> DataFrame:
    return df.where(F.octet_length("content") <= limit)


def binary_filter(df: DataFrame) -> DataFrame:
    return df.where(~is_binary(F.col("content").cast("binary")))


_STRAY, _NEXT = 0x10FF00, 0x10FE00
_ODD = "[\\x{10FE80}-\\x{10FEFF}\\x{10FF80}-\\x{10FFFF}]"


def _note(e: UnicodeDecodeError):
    bad = e.object[e.start : e.end]
    return chr(_STRAY + bad[0]) + "".join(chr(_NEXT + b) for b in bad[1:]), e.end


def escaped(raw: bytes) -> str:
    """Bytes as a valid string, stray ones as private characters."""
    codecs.register_error("quern_escape", _note)
    return raw.decode("utf-8", "quern_escape")


def unescaped(text: str) -> bytes:
    """The bytes again."""
    return re.sub("[\U0010fe80-\U0010feff\U0010ff80-\U0010ffff]", lambda m: chr(0xDC00 + (ord(m[0]) & 0xFF)), text).encode("utf-8", "surrogateescape")


def each(f: Callable[[bytes], bytes], kind: T.DataType):
    """f as a function of columns. Of a batch one text at a time is a Python object; what is kept of it are bytes. It counts
    as not deterministic, as Spark would run it once more for each filter that it moves before it."""

    def run(column: pa.Array) -> pa.Array:
        done = [None if x is None else f(x) for x in (v.as_buffer() if v.is_valid else None for v in column)]
        return pa.array(done, pa.binary()).cast(pa.string() if kind == T.StringType() else pa.binary())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind).asNondeterministic()


_escape = each(lambda raw: escaped(raw.to_pybytes()).encode(), T.StringType())


def shown(text: str | Column, odd: str | Column | None) -> Column:
    """A text as it is shown: one U+FFFD for each broken sequence."""
    text = F.col(text) if isinstance(text, str) else text
    if odd is None:
        return text
    lossy = F.regexp_replace(F.regexp_replace(text, "[\\x{10FE80}-\\x{10FEFF}]", ""), "[\\x{10FF80}-\\x{10FFFF}]", "\ufffd")
    return F.when(F.col(odd) if isinstance(odd, str) else odd, lossy).otherwise(text)


def in_file(prefix: Column, odd: str | None) -> Column:
    """How many bytes of the file a piece of the text is."""
    n = F.octet_length(prefix).cast("long")
    return n if odd is None else F.when(F.col(odd), n - 3 * F.regexp_count(prefix, F.lit(_ODD))).otherwise(n)


def text_of(df: DataFrame) -> tuple[DataFrame, str | None]:
    """content as a valid string, without binary rows and nulls, and the name of a column that tells rows with
    stray bytes (None where content is a string, which is taken as it is)."""
    if dict(df.dtypes)["content"] != "binary":
        return df.where(F.col("content").isNotNull()), None
    df = binary_filter(df)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    odd, text = "quern__odd", "quern__text"
    df = df.withColumn(odd, ~valid).withColumn(text, _escape(F.when(F.col(odd), F.col("content"))))
    return df.withColumn("content", F.coalesce(text, F.col("content").cast("string"))).drop(text), odd


def admits(o: SearchOptions) -> list[Column]:
    """Size, glob and type filters as predicates."""
    out = []
    if o.max_filesize is not None:
        out.append(F.octet_length("content") <= o.max_filesize)
    if o.glob is not None:
        out.append(F.col("file_path").rlike(glob_regex(o.glob)))
    if o.file_type is not None:
        out.append(extension("file_path") == o.file_type)
    return out


def filtered(df: DataFrame, o: SearchOptions) -> DataFrame:
    """Size, glob and type filters, ahead of any text work."""
    for p in admits(o):
        df = df.where(p)
    return df


def extension(path: str | Column) -> Column:
    """What follows the last dot of the file's name, if the name doesn't begin with that dot."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def lines(df: DataFrame, keep: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """(…, line_number, line_content): pieces between line feeds, the last one even where it is empty."""
    df, odd = text_of(df)
    rows = df.select(*keep, *([odd] if odd else []), F.posexplode(F.split("content", "\n", -1)).alias("at", "line_content"))
    return rows.select(*keep, (F.col("at") + 1).cast("long").alias("line_number"), shown("line_content", odd).alias("line_content"))


def _bail(df: DataFrame, regex: rx.Regex) -> DataFrame:
    """Drops documents without a match early; not for patterns that can match nothing, nor with text anchors."""
    if regex.nullable or regex.has_look("\\A", "\\z"):
        return df
    return df.where(F.col("content").rlike(regex.by_lines.java()))


def offsets(line: str, regex: rx.Regex, odd: str | None = None) -> tuple[Column, Column]:
    """Byte offsets of the first match in a line that has one."""
    java = regex.java()
    flags, body = java[: java.index(")") + 1], java[java.index(")") + 1 :]
    inner = flags.replace(")", ":") + body + ")"
    start = in_file(F.regexp_extract(line, rf"(?s:\A(.*?))(?:{inner})", 1), odd)
    return start, start + in_file(F.regexp_extract(line, java, 0), odd)


def search(corpus: DataFrame, pattern: str | list[str], options: SearchOptions | None = None, **kw) -> DataFrame:
    """(file_path, line_number, line_content, match_start, match_end): one row per matching line, its first
    match's byte offsets; with context > 0 also context_before and context_after. The rows are in no order: see listed()."""
    o = replace(options or SearchOptions(), **kw)
    one, regex = effective(pattern, o)
    kind = rx.kind(one) if isinstance(pattern, str) and not o.fixed else "normal"
    df, odd = text_of(filtered(corpus, o).select("file_path", "content"))
    own = ["file_path", *([odd] if odd else [])]
    if kind not in ("all",):
        df = _bail(df, regex)
    plain = kind == "char" and not o.ignore_case and not o.smart_case
    hits = lambda text: F.contains(text, F.lit(one)) if plain else text.rlike(regex.java())
    start, end = offsets("line_content", regex, odd)
    out = [F.col("file_path"), F.col("line_number"), shown("line_content", odd).alias("line_content"), start.alias("match_start"), end.alias("match_end")]
    pieces = F.split("content", "\n", -1)
    if kind == "all":  # the empty piece after the last line feed is no line
        pieces = F.when(F.col("content") == "", F.array().cast("array<string>")).when(F.col("content").endswith("\n"), F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    if o.max_count is None and not o.context:
        rows = df.select(*own, F.posexplode(pieces).alias("at", "line_content")).select(*own, (F.col("at") + 1).cast("long").alias("line_number"), "line_content")
        return (rows if kind == "all" else rows.where(hits(F.col("line_content")))).select(*out)
    numbered = df.select(*own, F.transform(pieces, lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("text"))).alias("all"))
    matched = F.col("all") if kind == "all" else F.filter("all", lambda x: hits(x["text"]))
    if o.max_count is not None:
        matched = F.slice(matched, F.lit(1), F.lit(o.max_count))
    rows = numbered.select(*own, "all", F.explode(matched).alias("m")).select(*own, "all", F.col("m.line").alias("line_number"), F.col("m.text").alias("line_content"))
    if o.context:
        first = F.greatest(F.lit(1), F.col("line_number") - o.context).cast("int")
        around = lambda x: x if odd is None else F.transform(x, lambda y: F.struct(y["line"].alias("line"), shown(y["text"], F.col(odd)).alias("text")))
        out.append(around(F.slice("all", first, F.col("line_number").cast("int") - first)).alias("context_before"))
        out.append(around(F.slice("all", (F.col("line_number") + 1).cast("int"), F.lit(o.context))).alias("context_after"))
    return rows.select(*out)


def listed(matches: DataFrame) -> DataFrame:
    """The matches in the order of a listing: by path and line."""
    return matches.orderBy("file_path", "line_number")


def count_per_file(matches: DataFrame) -> DataFrame:
    return matches.groupBy("file_path").agg(F.count("*").alias("n_lines")).orderBy("file_path")


def as_counts(matches: DataFrame) -> DataFrame:
    """(file_path, line): path:count of the matching lines of each file that has one."""
    return count_per_file(matches).select("file_path", F.concat_ws(":", "file_path", F.col("n_lines").cast("string")).alias("line"))


def files_with_matches(matches: DataFrame) -> DataFrame:
    return matches.select("file_path").distinct().orderBy("file_path")


def exists(matches: DataFrame) -> bool:
    return not matches.isEmpty()


def total(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("n_lines"))


def as_text(matches: DataFrame) -> DataFrame:
    """(file_path, line_number, line): path:line:content, and for context path-line-content; in the order of
    its input, so sort by listed() first where that matters."""
    head = F.concat_ws(":", "file_path", F.col("line_number").cast("string"), "line_content")
    if "context_before" not in matches.columns:
        return matches.select("file_path", "line_number", head.alias("line"))
    around = lambda c: F.transform(c, lambda x: F.concat_ws("-", "file_path", x["line"].cast("string"), x["text"]))
    return matches.select("file_path", "line_number", F.explode(F.concat(around("context_before"), F.array(head), around("context_after"))).alias("line"))


def as_json(matches: DataFrame) -> DataFrame:
    """(json): an object per match with file, line, content, match_start, match_end."""
    return matches.select(F.to_json(F.struct(F.col("file_path").alias("file"), F.col("line_number").alias("line"), F.col("line_content").alias("content"), "match_start", "match_end")).alias("json"))


def highlight(content: str, start: int, end: int, color: bool = True) -> str:
    """A match in bold red for a console, cut at bytes and decoded safely."""
    raw = content.encode()
    a, b, c = (x.decode("utf-8", "replace") for x in (raw[:start], raw[start:end], raw[end:]))
    return f"{a}\x1b[1;31m{b}\x1b[0m{c}" if color else content


def union_distinct(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()


def intersect(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, parts)
