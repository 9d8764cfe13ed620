"""What the third round changed: memory that doesn't grow with the texts, and texts that aren't shuffled."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quern.functions import ngram
from quern.operators import index


def peak(f) -> int:
    f()  # tables that are kept
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def prose(n: int, seed: int = 1) -> bytes:
    r = np.random.default_rng(seed)
    words = ["".join(chr(97 + x) for x in r.integers(0, 26, r.integers(2, 11))) for _ in range(4000)]
    return " ".join(words[i] for i in r.integers(0, 4000, n // 6)).encode()[:n]


def test_packing_works_in_pieces():
    """beside its result, packing needs memory for a piece, not for the whole shard."""
    text = prose(4 << 20)
    one, many = pa.array([text], pa.large_binary()), pa.array([text[i : i + 2500] for i in range(0, len(text), 2500)], pa.large_binary())
    for column in (one, many):
        assert peak(lambda c=column: ngram.packed(c)) < 60 * len(text)


@pytest.mark.parametrize("piece", [1, 7, 64, 300])
def test_pieces_lose_no_ngram(monkeypatch, piece):
    texts = [prose(700, 2), b"", b"x", None, b"ab", bytes(range(256)), "Été ".encode() * 30, b"a" * 129 + b"Zz", prose(200, 3)]
    monkeypatch.setattr(ngram, "PIECE", piece)
    key, row = ngram.packed(pa.array(texts, pa.binary()))
    assert set(zip(key.tolist(), row.tolist())) == {(ngram.key(t[a:b]), i) for i, t in enumerate(texts) if t for a, b in ngram.all_spans(t)}
    both = ngram.codes(pa.array(texts, pa.binary()))
    assert len(key) == len(both) and np.array_equal(ngram.edges(both), np.append(np.unique(key, return_index=True)[1], len(key)))


def test_common_ngrams_are_exact(spark, tmp_path, monkeypatch):
    """F8: counted from those that are often in a shard, whatever the rows of the others."""
    from collections import Counter

    from pyspark.sql import functions as F

    monkeypatch.setattr(index, "SHARD", 500)
    rows = [(f"/p/{i}", f"common {'half' if i % 2 else ''} {'third' if i % 3 == 0 else ''} {'front' if i < 90 else ''} {'few' if i < 60 else ''} {i}") for i in range(300)]
    root = str(tmp_path / "ix")
    state = index.build(spark.createDataFrame(rows, "file_path string, content string"), root)
    n = Counter(k for _, t in rows for k in {ngram.key(t.encode()[a:b]) for a, b in ngram.all_spans(t.encode())})
    assert state["base"]["common"] == sorted(k for k, x in n.items() if x > 75)
    heads = index.postings(spark, root, state["base"]).where(F.col("gram") == index.HEAD)
    assert heads.where("often is null").count() == 0 and heads.count() > 1
    assert index.status(spark, root).select("files", "grams", "overlay_grams").collect() == [(300, len(n), 0)]


def python_steps(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("EvalPython [")


def test_stray_bytes_pass_python_once(spark):
    """the pattern's filter doesn't bring a second pass; of a batch little more than its bytes is kept."""
    from quern.operators import replace, search

    rows = [("/a", b"caf\xe9 the end\nthe"), ("/b", b"the"), ("/c", b"\xff"), ("/d", None), ("/e", b"")]
    df = spark.createDataFrame(rows, "file_path string, content binary")
    found = search.search(df, "the")
    assert python_steps(found) == 1
    assert sorted(tuple(r) for r in found.collect()) == [("/a", 1, "caf\ufffd the end", 5, 8), ("/a", 2, "the", 0, 3), ("/b", 1, "the", 0, 3)]
    made = replace.replaced(df, "the", "a")
    assert python_steps(made) == 2  # to characters and back
    assert sorted((r.file_path, bytes(r.content), r.n_matches) for r in made.collect()) == [("/a", b"caf\xe9 a end\na", 2), ("/b", b"a", 1)]


def test_a_batch_of_stray_bytes_is_kept_as_bytes():
    from quern.operators import replace, search

    text = prose(2 << 20)
    texts = [b"\xe9" + text[i : i + 2500] for i in range(0, len(text), 2500)]
    raw = pa.array([*texts, None], pa.binary())
    assert peak(lambda: search._escape.func(raw)) < 3 * raw.nbytes
    chars = search._escape.func(raw)
    assert chars.type == pa.string() and [None if x is None else search.unescaped(x) for x in chars.to_pylist()] == [*texts, None]
    assert replace._unescape.func(chars).to_pylist() == [*texts, None]


def test_pairs_are_counted_in_pieces(monkeypatch):
    """beside the batch, counting needs memory for a piece; pairs over a text's end aren't counted wherever it lies."""
    from collections import Counter

    from quern.operators import stats

    text = prose(4 << 20)
    big = pa.record_batch([pa.array([text[i : i + 2500] for i in range(0, len(text), 2500)], pa.binary())], names=["content"])
    assert peak(lambda: list(stats._counted(iter([big])))) < 3 * len(text)
    texts = [b"aab", b"", None, b"b", b"", b"ba", prose(50), b"x" * 9, b""]
    want = Counter((t[i], t[i + 1]) for t in texts if t for i in range(len(t) - 1))
    for piece in (1, 2, 3, 8, 1 << 18):
        monkeypatch.setattr(stats, "PIECE", piece)
        for n in range(len(texts) + 1):
            parts = [pa.record_batch([pa.array(x, pa.binary())], names=["content"]) for x in (texts[:n], texts[n:])]
            (got,) = stats._counted(iter(parts))
            assert {(r["a"], r["b"]): r["n"] for r in got.to_pylist()} == want


def test_no_text_is_shuffled(spark, tmp_path, monkeypatch):
    """more candidates than go into a list, and the texts of an update, are found without shuffling the corpus;
    beyond MANY of them the results are the same."""
    monkeypatch.setattr(index, "FEW", 3)
    old = [(f"/p/{i}", f"text {i}\n{'quagga' if i % 9 == 0 else ''}") for i in range(300)]
    new = [(p, t + "\nzebra" if i % 10 == 0 else t) for i, (p, t) in enumerate(old) if i % 10 != 3] + [(f"/n/{i}", f"quagga new {i}") for i in range(5)]
    frames = [spark.createDataFrame(x, "file_path string, content string") for x in (old, new)]
    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        for many in (index.MANY, 0):
            monkeypatch.setattr(index, "MANY", many)
            root = str(tmp_path / f"ix{many}")
            index.build(frames[0], root)
            state = index.update(frames[1], root)
            assert (state["overlay"]["files"], state["tombstones"]) == (35, 60)
            paths = [r.file_path for r in index.candidates(spark, root, index.boolplan.build("zebra")).collect()]
            assert sorted(paths) == sorted(p for p, t in new if "zebra" in t)
            found = index.search(frames[1], root, "quagga")
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert [x.split()[0] for x in re.findall(r"\w+Join .*LeftSemi", plan)] == ["BroadcastHashJoin"] * bool(many)
            assert sorted(r.file_path for r in found.collect()) == sorted(p for p, t in new if "quagga" in t)
    finally:
        spark.conf.set(key, was)


def test_keys_are_kept_as_differences(spark, tmp_path):
    """the n-grams of a shard are in order, and Parquet keeps their differences."""
    import glob

    import pyarrow.parquet as pq

    root = str(tmp_path / "ix")
    state = index.build(spark.createDataFrame([("/a", prose(60000).decode())], "file_path string, content string"), root)
    kinds = [pq.ParquetFile(f).metadata.row_group(0).column(0) for f in glob.glob(f"{root}/{state['base']['folder']}/postings/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert [(c.path_in_schema, "DELTA_BINARY_PACKED" in c.encodings) for c in kinds] == [("gram", True)]


def test_slices_of_extract_are_small(spark):
    """n-grams of single texts need no shard; slices keep to their size, and nothing is lost."""
    text = prose(1 << 20)
    texts = [text[i : i + 2500] for i in range(0, len(text), 2500)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["file_id", "content"])
    for most in (3000, 1 << 17):
        parts = [pa.Table.from_batches(p) for p in index._texts(iter([batch, batch]), most)]
        assert max(sum(map(len, p.column(1).to_pylist())) for p in parts) <= most and pa.concat_tables(parts).column(0).to_pylist() == [*range(len(texts))] * 2
    df = spark.createDataFrame(list(enumerate(texts[:40])), "file_id long, content binary")
    want = [(i, len({ngram.key(t[a:b]) for a, b in ngram.all_spans(t)})) for i, t in enumerate(texts[:40])]
    assert sorted(tuple(r) for r in index.extract(df).groupBy("file_id").count().collect()) == want
