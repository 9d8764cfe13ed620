"""What the fourth round changed: an index of few rows, and n-grams that are found without looking up places."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import ngram
from quern.operators import index
from quern.plans import boolplan
from tests.test_round_3 import prose


def grams(text: bytes) -> set[int]:
    return {ngram.key(text[a:b]) for a, b in ngram.all_spans(text)}


@pytest.mark.parametrize("rows", [1, 50, 1 << 18])
def test_postings_are_packed(spark, tmp_path, monkeypatch, rows):
    """F7, F8, F10: a shard has a row for each beginning of keys, and every n-gram and place can be had from it."""
    monkeypatch.setattr(index, "ROWS", rows)
    text = prose(4000)
    texts = [text[i : i + 80] for i in range(0, len(text), 80)] + [b"", b"x", b"ab", b"ab"]
    batch = pa.record_batch([pa.array([f"/{i}" for i in range(len(texts))]), pa.array(texts, pa.binary()), pa.nulls(len(texts), pa.string())], names=["file_path", "content", "origin"])
    parts = list(index._shards(iter([batch])))
    want = defaultdict(list)
    for i, t in enumerate(texts):
        for k in sorted(grams(t)):
            want[k].append(i)
    made = pa.Table.from_batches(parts[1:])
    assert made.column("gram").to_pylist() == sorted({k >> 32 for k in want}) and sum(made.column("n").to_pylist()) == sum(map(len, want.values()))
    pa_rows = spark.createDataFrame(pa.Table.from_batches(parts).select(["gram", "shard", "n", *index._PACKED])).where("gram >= 0")
    assert {r.gram: (r.n, r.docs) for r in index.lists(pa_rows, docs=True).collect()} == {k: (len(x), x) for k, x in want.items()}
    some = sorted(want)[::9]
    assert sorted((r.gram, r.n) for r in index.lists(pa_rows, [*some, 5]).collect()) == [(k, len(want[k])) for k in some]


def test_a_row_holds_many_ngrams(spark, tmp_path):
    root, text = str(tmp_path / "ix"), prose(1 << 20)
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(33, 127, 9, np.uint8)).decode() for _ in range(60000)]
    state = index.build(spark.createDataFrame([("/a", text.decode()), ("/b", " ".join(words)), ("/c", None)], "file_path string, content string").coalesce(1), root)
    rows = index.postings(spark, root, state["base"])
    n = index.status(spark, root).first().grams
    assert n == len(np.unique(ngram.packed(pa.array([text, " ".join(words).encode()], pa.binary()))[0]))
    assert rows.count() < min(n / 2, (1 << 16) * rows.where(F.col("gram") == index.HEAD).count() + 9)
    assert [r.file_path for r in index.candidates(spark, root, boolplan.build(text[:40].decode())).collect()] == ["/a"]


def test_an_index_of_another_layout_is_built_anew(spark, tmp_path):
    root = str(tmp_path / "ix")
    df = spark.createDataFrame([("/a", "some text"), ("/b", "other text")], "file_path string, content string")
    state = index.build(df, root)
    index._commit(spark, root, {k: v for k, v in state.items() if k != "layout"}, state)
    with pytest.raises(ValueError, match="layout"):
        index.search(df, root, "other")
    assert index.update(df, root)["base"] != state["base"]
    assert [r.file_path for r in index.search(df, root, "other").collect()] == ["/b"]


def test_short_ngrams_at_the_ends_of_texts():
    """None reaches into the next text, wherever texts and pieces end; rows of one byte have none."""
    texts = [b"a", b"b", b"cd", b"", b"e", b"fgh", b"i", b"jk", b"l" * 140 + b"Q1"] * 3
    old = ngram.PIECE
    try:
        for piece in (1, 2, 5, 40, old):
            ngram.PIECE = piece
            key, row = ngram.packed(pa.array(texts, pa.binary()))
            assert sorted(zip(row.tolist(), key.tolist())) == sorted((i, k) for i, t in enumerate(texts) for k in grams(t))
    finally:
        ngram.PIECE = old


def test_small_shards_bring_no_common_ngrams(spark, tmp_path, monkeypatch):
    """F8, F10: of a text that is a shard of its own every n-gram is often there; they aren't counted (before, all went to
    the driver and into one list of a filter)."""
    monkeypatch.setattr(index, "SHARD", 4000)
    rows = [(f"/p/{i}", f"common text {i}") for i in range(400)] + [("/big", prose(20000).decode())]
    root, asked, real = str(tmp_path / "ix"), [], index.lists
    monkeypatch.setattr(index, "lists", lambda rows, keys=None, docs=False: asked.append(len(keys)) or real(rows, keys, docs))
    state = index.build(spark.createDataFrame(rows, "file_path string, content string"), root)
    assert set(state["base"]["common"]) >= grams(b"common text ") and len(asked) == 1 and asked[0] < 200 < len(grams(rows[-1][1].encode()))
    assert [r.file_path for r in index.candidates(spark, root, boolplan.build(rows[-1][1][:60])).collect()] == ["/big"]


def test_order_0_sorts_a_block_once(monkeypatch):
    """op9: what order 0 has seen isn't sorted and looked through again for each segment; the steps are those of a count."""
    from quern.llm import binary

    x = np.random.default_rng(2).integers(0, 50000, 16384).astype(np.uint16)
    x[5000:6000] = x[:1000]
    done = []
    for name in ("sort", "argsort", "searchsorted"):
        real = getattr(np, name)
        monkeypatch.setattr(binary.np, name, lambda a, *rest, real=real, name=name, **kw: done.append(len(rest[0]) if name == "searchsorted" else len(a)) or real(a, *rest, **kw))
    cum, freq, total = binary.model(x, 50257)
    monkeypatch.undo()
    assert sum(done) < 2 * len(x)
    escape = np.flatnonzero(~(binary._slots(x) == x.astype(np.int32)).any(axis=0))
    for a in binary.cuts(len(x)):
        seen = np.bincount(x[escape[escape < a]], minlength=50257)
        i = escape[escape >= a][0]
        weight = int(freq[i]) // (1 + 64 * int(seen[x[i]]))
        assert int(total[i]) >> 11 == 50257 + 64 * int(seen.sum()) and int(freq[i]) == weight * (1 + 64 * int(seen[x[i]]))
    assert np.array_equal(binary.decode(binary.encode([x], 50257)[0], len(x), 50257), x)


def test_single_pieces_are_those_of_the_pattern():
    """op9: pieces go to the vocabulary without the pattern, and give its ids."""
    from quern.llm import binary

    r = np.random.default_rng(4)
    parts = ["the", " a", "  ", "\n", "\n\n ", "'s", "'", "''ll", "'re", " 'd", "12", " 345", "!?", " --", "é", " été", "\t", "x'sy", "日本", "_", "\r\n", " '", "'ve1"]
    texts = ["".join(parts[i] for i in r.integers(0, len(parts), r.integers(0, 30))) for _ in range(2000)]
    w = binary.Words(binary.VOCABULARY)
    for _ in range(2):  # the second time from what is kept
        assert [x.tolist() for x in w.many(texts)] == [w.bpe.encode_ordinary(t) for t in texts]
    assert all(isinstance(x, bytes) for x in w.kept.values())
