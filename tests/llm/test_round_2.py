"""Cases of the second round: long payloads in linear time, hidden characters, learned whole words."""

import io
import random
import time
import zipfile

import numpy as np
import pandas as pd
import pytest

from quern.llm import binary, chat, compression, media, minhash, mixing, packing, secrets, substring, toxicity


def took(f, *a):
    began = time.time()
    out = f(*a)
    return out, time.time() - began


# secrets


def test_compiling_is_quick():
    secrets.compile_rules.cache_clear()
    c, seconds = took(secrets.compile_rules)
    assert len(c.forward.table) // c.forward.width < 6000 and seconds < 10


def test_long_values_take_linear_time():
    c = secrets.compile_rules()
    rng = random.Random(1)
    long = "".join(rng.choices("ABCDEFabcdefghijkl0123456789", k=1 << 20))
    for text, want in ((f"token={long}", [(0, len(long) + 6, 7)]), (f"x eyJ{long} y", []), ("secret=" * 100_000, []), (f"a eyJ{long}.eyJ{long} b", [(2, 2 * len(long) + 9, 6)]), (" eyJ" + "eyJa." * 100_000, [(1, 500_004, 6)])):
        got, seconds = took(secrets.scan_texts, [text.encode()], c)
        assert got == [want] and seconds < 30
    text = f"a token={long} b".encode()
    assert secrets.redacted(text, secrets.scan_texts([text], c)[0], c) == b"a [assigned_secret] b"


def test_open_run_of_a_rule_with_a_right_edge():
    with pytest.raises(ValueError):
        secrets.compile_rules((secrets.Rule("x", r"k[a-z\-]+"),))
    c = secrets.compile_rules((secrets.Rule("x", r"k[a-c]+"), secrets.Rule("y", r"b(?:q|[x-z]{2,})", left=False, right=False)))
    assert secrets.scan_texts([b"kabc kabd kab_ bq bxx bx kbq"], c) == [[(0, 4, 0), (15, 17, 1), (18, 21, 1), (26, 28, 1)]]


# media


def archive(n, name="f", data="x"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(n):
            z.writestr(f"{name}{i}", data)
    return out.getvalue()


def test_archives_take_linear_time():
    a = media.automaton()
    for n in (3, 100_000):  # the second has more entries than the short form counts
        d = archive(n)
        got, seconds = took(media.sniff, d, a)
        assert got[:2] == ("application/zip", True) and not got[2] and seconds < 20
    inner = archive(2)
    both = archive(1, data=inner) + b"tail" + inner
    kind, whole, carved = media.sniff(both, a)
    assert kind == "application/zip" and [(o, n) for o, n, *_ in carved] == [(both.index(inner), len(inner)), (both.rindex(inner), len(inner))]
    got, seconds = took(media.sniff, b"PK\x03\x04" * 300_000, a)
    assert got[0] == "application/octet-stream" and seconds < 20


# toxicity


def test_hidden_characters_break_up_no_word():
    a = toxicity.base_lexicon().automaton()
    for c in ("\u00ad", "\u200b", "\u200d", "\u2060", "\ufeff", "\u0301", "\ufe0f"):
        assert toxicity.measure(f"you i{c}d{c}io{c}t", a)[1] == 1, hex(ord(c))
        assert toxicity.measure(f"a f{c}ine d{c}ay", a)[1] == 0
    assert toxicity.measure("\u200b", a) == (0.0, 0, 1) or toxicity.measure("\u200b", a)[1] == 0


def test_learned_words_are_whole_words():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("bcdfgklmnprst", k=7))
    texts, toxic = [], []
    for i in range(300):
        own = [word() for _ in range(60)]
        if i % 2:
            own[5] = own[25] = "zarp"
        else:
            own[7] = "zarping" + word()
        texts.append(" ".join(own))
        toxic.append(i % 2)
    lexicon = toxicity.learn(texts, toxic)
    entry = next(e for e in lexicon.entries if e[0].startswith("zarp"))
    assert entry[0] == "zarp" and entry[2] is True
    a = lexicon.automaton()
    assert toxicity.measure("a zarp b", a)[1] == 1 and toxicity.measure("a zarping b", a)[1] == 0


# near duplicates


def test_large_sets_lose_no_link(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(500)]
    head = " ".join(rng.choices(words, k=40))
    texts = []
    for _ in range(40):
        base = head.split() + rng.choices(words, k=rng.choice([5, 20, 60]))
        for _ in range(rng.choice([1, 2, 9])):
            texts.append(" ".join(w if rng.random() > 0.02 else "x" for w in base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {tuple(r) for r in minhash.near_duplicates(df).collect()}
    monkeypatch.setattr(minhash, "HOT", 5)
    monkeypatch.setattr(minhash, "WIDE", 7)
    monkeypatch.setattr(minhash, "SAMPLE", 1)
    assert {tuple(r) for r in minhash.near_duplicates(df).collect()} == want and len({r[1] for r in want}) > 2


def test_a_large_set_of_unlike_ids(spark):
    """50,000 ids in one set, none alike but for 300 pairs and a group of 9,000."""
    p = minhash.Params()
    rng = np.random.default_rng(5)
    n = 50_000
    sketch = rng.integers(0, 1 << 64, (n, p.bits // 64), np.uint64)
    pairs = [(i, n - 1 - i) for i in range(300)]
    for a, b in pairs:
        sketch[b] = sketch[a]
        sketch[b, 0] ^= np.uint64(5)
    sketch[20_000:29_000] = sketch[20_000]
    schema = "key long, n long, id long, sketch binary"
    hot = spark.createDataFrame(pd.DataFrame({"key": 1, "n": n, "id": np.arange(n), "sketch": [r.tobytes() for r in sketch]}), schema)
    began = time.time()
    links = minhash._large(hot, p, spark.createDataFrame([], "u long, v long"))
    got = {(r.id, r.root) for r in minhash.components(spark, links).collect()}
    assert got == {(b, a) for a, b in pairs} | {(i, 20_000) for i in range(20_001, 29_000)}
    assert time.time() - began < 300


def test_scripts_without_blanks(spark):
    rng = random.Random(12)
    text = "".join(chr(rng.randrange(0x4E00, 0x9F00)) + ("，" if i % 17 == 16 else "") for i in range(400))
    thai = "".join(chr(rng.randrange(0xE01, 0xE2E)) for _ in range(300))
    df = spark.createDataFrame([(0, text), (1, text[:200] + "變" + text[201:]), (2, thai), (3, thai[:100] + "ก" + thai[101:]), (4, text[::-1])], "doc_id long, text string")
    assert {(r.doc_id, r.kept_id) for r in minhash.near_duplicates(df).collect()} == {(1, 0), (3, 2)}


def test_ids_that_are_text(spark):
    df = spark.createDataFrame([("7", "a b c d"), ("9", "a b c d"), ("x", "a b c d"), (None, "a b c d")], "doc_id string, text string")
    assert [(r.doc_id, r.kept_id) for r in minhash.near_duplicates(df).collect()] == [(9, 7)]
    assert sorted(map(repr, (r.doc_id for r in minhash.keep_one(df).collect()))) == ["'7'", "'x'", "None"]


# all


def test_ids_that_are_text_and_frames_without_text(spark):
    toxic, key = "you idiot moron scum", "AKIA" + "A1B2" * 4
    df = spark.createDataFrame([("7", toxic, "a"), ("x", key, "a"), (None, "fine", None)], "doc_id string, text string, source string")
    lex = toxicity.base_lexicon()
    assert [(r.doc_id, r.toxic) for r in toxicity.score(df, lex).orderBy("toxic", "words").collect()] == [(None, False), (None, False), (7, True)]
    assert [(r.doc_id, r.rule) for r in secrets.find(df).collect()] == [(None, "aws_access_key")]
    assert compression.compression_bands(df).count() == binary.read(binary.write(df)).count() == 3
    assert {r.doc_id for r in mixing.mixed(df).collect()} == {"7", "x", None}
    assert sum(r.length for r in packing.best_fit(df).collect()) == len(toxic) + len(key) + len("fine") + 3
    assert media.inspect(df, "doc_id", "text", "source").count() == 3 and substring.repeats(df).count() == 0
    bare = df.select("doc_id", "source")
    assert toxicity.keep_clean(bare, lex).count() == secrets.redact(bare).count() == minhash.keep_one(df.select("doc_id", "text")).count() == 3


def test_chat_query_recovers_lost_markers(spark):
    """Held out: the model learns on one half, the other is written in mixed styles with a tenth of the markers lost."""
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    half = lambda k: df.where(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == k)
    model = chat.fit(spark, half(0))
    texts = chat.transcripts(half(1), mixed=True)
    shown = {r.conv_id: r.text for r in texts.collect()}
    assert sum("### " in t for t in shown.values()) > 50 < sum("**" in t for t in shown.values())
    want: dict = {}
    for r in sorted(half(1).collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append(r.role)
    got = {r.conv_id: list(r.roles) for r in chat.formatted(texts, model).collect()}
    assert got.keys() == want.keys() and sum(got[c] == want[c] for c in want) >= 0.8 * len(want)


def test_mixture_codes_better_than_zlib():
    """10 % at least under zlib on the same ids of whole documents."""
    import zlib

    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    w = binary.words()
    ids = np.concatenate(w.many(texts))
    blocks = [ids[i : i + binary.BLOCK] for i in range(0, len(ids), binary.BLOCK)]
    size = sum(map(len, binary.encode(blocks, w.size)))
    assert size < 0.9 * sum(len(zlib.compress(x.astype("<u2").tobytes(), 6)) for x in blocks)
    part = blocks[1][:3000]
    assert (binary.decode(binary.encode([part], w.size)[0], len(part), w.size) == part).all()


# pipeline


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    rows = [(1, text, "a"), (2, text, "a"), (2, text, "a"), (3, None, None), (4, "", "b"), (None, "you idiot moron", "a"), (None, "fine day", None), (5, "é key AKIA" + "A1B2" * 4, "b"), (6, "z " * 200_000, "b")]
    schema = "doc_id long, text string, source string, gone int, row long, file string, bin long, slot long, mix_id string"
    for n in (len(rows), 0):
        d = tmp_path / str(n)
        spark.createDataFrame([(*r, 1, 2, "f", 3, 4, "m") for r in rows[:n]], schema).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, 0, 0), (None, 1, 1)][: min(n, 2)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        got = cp.run(spark, str(d)).collect()
        if not n:
            assert got == []
            continue
        mixture = spark.read.parquet(got[0].file.rsplit("/", 1)[0])
        assert mixture.columns == [c.split()[0] for c in schema.split(", ")]
        kept = {(r.doc_id, r.text) for r in mixture.collect()}
        assert kept == {(1, text), (3, None), (4, ""), (None, "fine day"), (5, "é key [aws_access_key]"), (6, "z " * 200_000)}
        assert {r.doc_id for r in got} == {1, None, 5, 6} and all(r.used <= r.capacity for r in got)
