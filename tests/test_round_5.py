"""What the fifth round changed: an index of a table that lies evenly is built where its texts lie, and candidates are found once."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.functions import ngram
from quern.operators import index
from quern.plans import boolplan
from tests.test_round_3 import prose


def written(root: str, state: dict) -> int:
    """How many tasks wrote postings."""
    return sum(pq.ParquetFile(f).metadata.num_rows > 0 for f in glob.glob(f"{root}/{state['base']['folder']}/postings/*.parquet"))


@pytest.mark.parametrize("files, sizes, tasks", [(9, [1] * 9, 9), (2, [12, 1], 4), (1, [40], 10)])
def test_texts_are_spread_only_where_they_lie_unevenly(spark, tmp_path, monkeypatch, files, sizes, tasks):
    """F8, F10: small tables were shuffled into a task for each core, whatever they lay in (files of equal size were
    shuffled, and tasks grew with the input); large ones stayed in one task where they were one row group."""
    monkeypatch.setattr(index, "SHARD", 8000)
    if files == 1:
        monkeypatch.setattr(index, "SPREAD", 32000)
    text = prose(400_000).decode()
    rows, at = [], 0
    (tmp_path / "t").mkdir()
    for i, n in enumerate(sizes):
        own = [(f"/{i}/{k}", text[(at + k) * 400 : (at + k + 1) * 400]) for k in range(20 * n)]
        at += 20 * n
        pq.write_table(pa.table({"file_path": [p for p, _ in own], "content": [x for _, x in own]}), str(tmp_path / "t" / f"{i}.parquet"))
        rows += own
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(was, ("1m", "1m")):  # a task for each file
        spark.conf.set(k, v)
    try:
        root = str(tmp_path / "ix")
        table = spark.read.parquet(str(tmp_path / "t"))
        state = index.build(table, root)
        assert (written(root, state), state["base"]["files"]) == (tasks, len(rows))
        key = boolplan.build(text[4010:4060])
        assert [r.file_path for r in index.candidates(spark, root, key).collect()] == [p for p, x in rows if text[4010:4060] in x]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_short_ngrams_are_hashed_once_a_text(monkeypatch):
    """F8, F10: of a piece, repeats of n-grams of two and three bytes go before they are hashed and sorted with the others."""
    text = prose(200_000)
    texts = [text[i : i + 2500] for i in range(0, len(text), 2500)]
    ngram._short(2)
    done, real = [], ngram._mixed
    monkeypatch.setattr(ngram, "_mixed", lambda x: done.append(len(x)) or real(x))
    ngram.codes(pa.array(texts, pa.binary()))
    assert done[0] == sum(len({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts) < len(text)


@pytest.mark.parametrize("piece", [3, 50, 1 << 18])
def test_ngrams_of_many_and_of_extreme_rows(monkeypatch, piece):
    """More rows to a piece than a byte counts, and bytes that look like the mark of what lies in two texts."""
    monkeypatch.setattr(ngram, "PIECE", piece)
    texts = [b"ab", b"\xff\xff", b"", b"\xff\xff\xff", b"x", b"abc"] * 120 + [b"\xff" * 9]
    key, row = ngram.packed(pa.array(texts, pa.binary()))
    assert sorted(zip(row.tolist(), key.tolist())) == sorted((i, k) for i, t in enumerate(texts) for k in {ngram.key(t[a:b]) for a, b in ngram.all_spans(t)})
    full = [b"\xff\xff\xff"] * ngram.MOST_ROWS
    assert np.array_equal(np.bincount(ngram.packed(pa.array(full, pa.binary()))[1]), np.full(len(full), 2))


def test_candidates_are_looked_up_once(spark, tmp_path, monkeypatch):
    """a search of more than FEW candidates read the postings three times."""
    monkeypatch.setattr(index, "FEW", 3)
    rows = [(f"/p/{i}", f"text {i}\n{'quagga' if i % 9 == 0 else ''}") for i in range(300)]
    df, root = spark.createDataFrame(rows, "file_path string, content string"), str(tmp_path / "ix")
    index.build(df, root)
    found = index.search(df, root, "quagga")
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.file_path for r in found.collect()) == sorted(p for p, t in rows if "quagga" in t)


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """on two cores an executor's memory passed 3,000 MB, as a batch of 64 MB lay beside each shard."""
    monkeypatch.setattr(index, "SHARD", 1 << 16)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(prose(1000, i),) for i in range(400)], "content binary").coalesce(1)
    batches = lambda: [r.n for r in df.mapInArrow(lambda it: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in it), "n long").collect()]
    for own, most in ((None, 1 << 16), ("20000", 20000)):
        if own:
            spark.conf.set(key, own)
        try:
            with index._small_batches(spark):
                assert max(batches()) < most + 3000
            assert spark.conf.get(key, None) == own
        finally:
            spark.conf.unset(key)
    assert len(batches()) == 1
