"""Replacement over whole texts: a preview by lines, counts, and new versions of the corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import regex as rx
from quern.operators.search import SearchOptions, admits, each, effective, filtered, is_binary, shown, text_of, unescaped


def _made(pattern: str, replacement: str, o: SearchOptions) -> tuple[rx.Regex, Column]:
    _, regex = effective(pattern, o)
    parts = rx.template(replacement, regex, literal=o.fixed)
    return regex, F.regexp_replace("content", F.lit(regex.java()), F.lit(rx.java_template(list(parts), regex)))


_unescape = each(lambda text: unescaped(text.to_pybytes().decode()), T.BinaryType())


def _bytes(text: Column, odd: str | None) -> Column:
    """A text as its bytes in the file (a string where it was one)."""
    return text if odd is None else F.coalesce(_unescape(F.when(F.col(odd), text)), text.cast("binary"))


def replaced(corpus: DataFrame, pattern: str, replacement: str, options: SearchOptions | None = None) -> DataFrame:
    """(file_path, content, n_matches): the texts that change; ^ and $ are the ends of the text. content has the type
    it had; of binary content all bytes that no match covers stay as they are, UTF-8 or not."""
    o = options or SearchOptions()
    regex, new = _made(pattern, replacement, o)
    df, odd = text_of(filtered(corpus, o))
    df = df.where(F.col("content").rlike(regex.java()))
    df = df.select("file_path", *([odd] if odd else []), new.alias("new"), F.regexp_count("content", F.lit(regex.java())).cast("long").alias("n_matches"), "content").where("new != content")
    return df.select("file_path", _bytes(F.col("new"), odd).alias("content"), "n_matches")


def preview(corpus: DataFrame, pattern: str, replacement: str, options: SearchOptions | None = None) -> DataFrame:
    """(file_path, line_number, original, replaced): lines that differ, matched by number; a missing line is empty."""
    o = options or SearchOptions()
    regex, new = _made(pattern, replacement, o)
    df, odd = text_of(filtered(corpus, o))
    df = df.where(F.col("content").rlike(regex.java()))
    pairs = F.zip_with(F.split("content", "\n", -1), F.split(new, "\n", -1), lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")))
    rows = df.select("file_path", *([odd] if odd else []), F.posexplode(pairs).alias("at", "p")).where("p.a != p.b")
    return rows.select("file_path", (F.col("at") + 1).cast("long").alias("line_number"), shown(F.col("p.a"), odd).alias("original"), shown(F.col("p.b"), odd).alias("replaced"))


def totals(corpus: DataFrame, pattern: str, replacement: str, options: SearchOptions | None = None) -> DataFrame:
    """(files, matches, lines): what a replacement would change, from one scan."""
    o = options or SearchOptions()
    regex, new = _made(pattern, replacement, o)
    df, _ = text_of(filtered(corpus, o))
    df = df.where(F.col("content").rlike(regex.java())).select("content", new.alias("new"), F.regexp_count("content", F.lit(regex.java())).cast("long").alias("n")).where("new != content")
    differ = F.zip_with(F.split("content", "\n", -1), F.split("new", "\n", -1), lambda a, b: F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit("")))
    lines = F.size(F.filter(differ, lambda x: x)).cast("long")
    return df.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.coalesce(F.sum(lines), F.lit(0)).alias("lines"))


def apply(corpus: DataFrame, pattern: str, replacement: str, options: SearchOptions | None = None) -> DataFrame:
    """The corpus with changed texts in place of the old ones; rows that the options leave out stay as they are."""
    o = options or SearchOptions()
    regex, new = _made(pattern, replacement, o)
    ok = F.col("content").isNotNull()
    for p in admits(o):
        ok &= F.coalesce(p, F.lit(False))
    if dict(corpus.dtypes)["content"] != "binary":
        return corpus.withColumn("content", F.when(ok, new).otherwise(F.col("content")))
    old, may, bytes_ = "quern__old", "quern__may", "quern__bytes"
    ok = F.coalesce(ok & ~is_binary(F.col("content")), F.lit(False))
    rows = corpus.withColumn(old, F.col("content")).withColumn(may, ok).withColumn("content", F.when(F.col(may), F.col("content")).otherwise(F.lit(b"")))
    rows, odd = text_of(rows)
    rows = rows.withColumn(bytes_, _bytes(new, odd))
    done = F.when(F.col(may) & F.col("content").rlike(regex.java()), F.col(bytes_)).otherwise(F.col(old))
    return rows.withColumn("content", done).select(*[F.col(f"`{c}`") for c in corpus.columns])


def write_tree(changed: DataFrame, folder: str) -> int:
    """Writes (file_path, content) rows to the paths they came from, from the executors; how many. The new
    contents are first written to `folder`, which all share, so that a task that runs again doesn't replace twice.
    Files keep their mode; links are written through."""
    spark = changed.sparkSession
    changed.select("file_path", "content").write.parquet(folder)

    def put(batches):
        import os

        from quern.sources.corpus import real

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = os.path.realpath(real(path))
                part = own + b".%d.part" % os.getpid()
                with open(part, "wb") as f:
                    f.write(content if isinstance(content, bytes) else content.encode())
                os.chmod(part, os.stat(own).st_mode & 0o7777)
                os.replace(part, own)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return spark.read.parquet(folder).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
