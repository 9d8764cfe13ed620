"""Byte-pair statistics of a corpus, and the n-gram weights that follow from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pairs that are counted at once: their codes take eight times that.
PIECE = 1 << 18


def _counted(batches):
    """The pairs of all batches, as one batch (a, b, n)."""
    total = np.zeros(65536, np.int64)
    for b in batches:
        col = b.column(0)
        col = (pc.fill_null(col, b"") if col.null_count else col).cast(pa.large_binary())
        _, offsets, data = col.buffers()
        at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        if len(raw) < 2:
            continue
        cut = at[1:-1] - at[0]
        cut = cut[(cut > 0) & (cut < len(raw))] - 1  # the pairs that lie in two texts
        for i in range(0, len(raw) - 1, PIECE):
            x = raw[i : i + PIECE + 1]
            code = x[:-1].astype(np.uint16) << 8 | x[1:]
            total += np.bincount(code, minlength=65536)
            own = np.unique(cut[np.searchsorted(cut, i) : np.searchsorted(cut, i + len(code))]) - i
            total -= np.bincount(code[own], minlength=65536)
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array((k >> 8).astype(np.int32)), pa.array((k & 255).astype(np.int32)), pa.array(total[k])], names=["a", "b", "n"])


def pair_frequency(corpus: DataFrame) -> DataFrame:
    """(a, b, n): how often byte b follows byte a inside a text. Each task sums up first, so that at most
    65,536 rows per task are shuffled."""
    part = corpus.select(F.col("content").cast("binary").alias("content")).mapInArrow(_counted, "a int, b int, n long")
    return part.groupBy("a", "b").agg(F.sum("n").alias("n"))


def top_pairs(pairs: DataFrame, k: int = 20) -> DataFrame:
    return pairs.orderBy(F.desc("n"), "a", "b").limit(k)


def corpus_weights(pairs: DataFrame) -> DataFrame:
    """(a, b, weight) of the pairs that occur: the highest count by (count + 1), in whole numbers, 1 to 251.
    Pairs that never occur have the highest weight."""
    top = pairs.agg(F.max("n").alias("top"))
    return pairs.crossJoin(top).select("a", "b", F.least(F.lit(251), F.greatest(F.lit(1), F.floor(F.col("top") / (F.col("n") + 1)))).cast("long").alias("weight"))
