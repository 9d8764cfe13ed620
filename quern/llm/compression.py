"""Quality by compression bands.

A document's zstandard ratio (bytes / compressed bytes, level 3) is held against limits that depend
on its length, since short texts compress badly. Fixed chunks of `chunk` bytes are held against the
limits for their own length, so that a repetitive or random stretch inside a long text shows. Too high
a ratio is repetitive, too low incompressible. A document is rejected where its own ratio is outside
its band, or where more than `share` of its chunks are.

Defined results: null and empty texts have 0 bytes, a null ratio, and are rejected as "empty". A
rest shorter than a quarter of `chunk` belongs to the chunk before it, so every byte is judged. Each row is
judged by its own text (repeated rows get equal results); an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import pick, slices

#: (from so many bytes, least ratio, most ratio)
BANDS = ((0, 0.4, 1.4), (64, 0.75, 1.8), (128, 0.95, 2.3), (256, 1.1, 2.6), (512, 1.2, 2.8), (1024, 1.35, 3.2), (4096, 1.5, 3.8), (16384, 1.5, 4.5), (131072, 1.5, 5.5))
SCHEMA = "doc_id long, n_bytes long, ratio double, chunks long, low_chunks long, high_chunks long, keep boolean, reason string"


def verdict(n: int, ratio: float, bands=BANDS) -> int:
    """-1 incompressible, 0 inside the band, 1 repetitive."""
    _, low, high = bands[bisect_right([b[0] for b in bands], n) - 1]
    return (ratio > high) - (ratio < low)


def judge(data: bytes, compressor: zstandard.ZstdCompressor, bands=BANDS, chunk: int = 4096, share: float = 0.25) -> tuple:
    """(bytes, ratio, chunks judged, chunks below, chunks above, keep, reason)"""
    n = len(data)
    if not n:
        return 0, None, 0, 0, 0, False, "empty"
    ratio = n / len(compressor.compress(data))
    whole = verdict(n, ratio, bands)
    low = high = count = 0
    if n <= chunk:
        count, low, high = 1, int(whole < 0), int(whole > 0)
    else:
        view = memoryview(data)
        starts = list(range(0, n, chunk))
        if (n - starts[-1]) * 4 < chunk:
            starts.pop()
        for i, end in zip(starts, [*starts[1:], n]):
            part = view[i:end]
            count += 1
            v = verdict(len(part), len(part) / len(compressor.compress(part)), bands)
            low, high = low + (v < 0), high + (v > 0)
    reason = {1: "repetitive", -1: "incompressible"}.get(whole)
    if reason is None and high > share * count:
        reason = "repetitive chunks"
    if reason is None and low > share * count:
        reason = "incompressible chunks"
    return n, ratio, count, low, high, reason is None, reason or "kept"


def compression_bands(docs: DataFrame, *, level: int = 3, bands=BANDS, chunk: int = 4096, share: float = 0.25) -> DataFrame:
    """One row per document with its ratios and decision."""

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for b in slices(batches, "t"):
            texts = b.column(1).cast(pa.binary())
            got = [judge(x.as_buffer() if x.is_valid else b"", compressor, bands, chunk, share) for x in texts]
            cols = list(zip(*got))
            types = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "ratio", "chunks", "low_chunks", "high_chunks", "keep", "reason"])

    return pick(docs, k="doc_id", t="text").select(F.col("k").try_cast("long").alias("k"), "t").mapInArrow(run, SCHEMA)
