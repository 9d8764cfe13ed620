import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import ngram
from quern.functions import regex as rx
from quern.functions.glob import Ignore, glob_regex
from quern.plans import boolplan

BYTES = st.binary(max_size=60) | st.text(alphabet="abcdeXY _9.\n", max_size=60).map(str.encode)


def plain(data: bytes):
    w = ngram.pair_weights(data).tolist()
    out = []
    for s in range(len(data)):
        for e in range(s + 2, min(len(data), s + ngram.LONGEST) + 1):
            p = w[s : e - 1]
            if len(p) <= 2 or max(p[1:-1]) < min(p[0], p[-1]):
                out.append((s, e))
    return out


@settings(max_examples=150, deadline=None)
@given(BYTES)
def test_spans_equal_the_definition(data):
    assert ngram.all_spans(data) == plain(data)


@settings(max_examples=150, deadline=None)
@given(BYTES)
def test_cover_is_made_of_spans_and_covers(data):
    grams = ngram.cover(data)
    own = {data[s:e] for s, e in ngram.all_spans(data)}
    assert set(grams) <= own
    if len(data) >= 2:
        assert len(grams) == least_cover(data)


def least_cover(data: bytes) -> int:
    spans, best = ngram.all_spans(data), [0] + [10**6] * (len(data) - 1)
    for i in range(1, len(data)):  # best[i]: n-grams for the first i pairs
        best[i] = min(best[max(s, 0)] + 1 for s, e in spans if s <= i - 1 < e - 1) if i else 0
        best[i] = min(min(best[j] for j in range(s, i)) + 1 for s, e in spans if s < i <= e - 1)
    return best[len(data) - 1]


@settings(max_examples=100, deadline=None)
@given(BYTES, BYTES, BYTES)
def test_grams_of_a_part_are_in_the_whole(a, b, c):
    import pyarrow as pa

    _, whole = ngram.grams(pa.array([a + b + c], pa.binary()))
    assert {ngram.key(g) for g in ngram.cover(b)} <= set(whole.tolist())


def test_known_covers():
    assert ngram.cover(b"handleExport") == [b"handleE", b"eExpo", b"port"]
    assert ngram.cover(b"hello_world") == [b"hel", b"ello", b"o_w", b"_world"]
    assert ngram.cover(b"") == ngram.cover(b"x") == []


@pytest.mark.parametrize("bad", ["(?=a)", "a++", r"\1", "a{2,1}", "(", ")", "[a", "*", r"\q", "[a&&b]", "(?R)", "a{,3}", "(?P<x>a)(?P<x>b)", "[z-a]", "\\"])
def test_refused_patterns(bad):
    with pytest.raises(rx.RegexError):
        rx.parse(bad)


PATTERNS = ["a.c", "^a|b$", "(?i)aB[c-e]", "x{2,3}?y*", "(?:ab)+", r"\d+\.\d", "[^a]b", "(a)(?P<n>b)", r"\x41\t", "[]a]", "(?s).", "a|", "", "(?i:a)b"]


@pytest.mark.parametrize("p", PATTERNS)
def test_re2_form_means_the_same(p):
    import duckdb

    rng = random.Random(7)
    texts = ["".join(rng.choice("aAbBcxy1.]\t") for _ in range(rng.randint(0, 8))) for _ in range(120)]
    own = re.compile(p.replace("$", r"\Z"))
    got = [r[0] for r in duckdb.execute("select regexp_matches(x, ?) from (select unnest(?) as x)", [rx.parse(p).re2(), texts]).fetchall()]
    assert got == [bool(own.search(t)) for t in texts]


def test_java_form_means_the_same(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = ["".join(rng.choice("aAbBcxy1.]\té\r") for _ in range(rng.randint(0, 8))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = df.select(*[F.col("x").rlike(rx.parse(p).java()).alias(str(i)) for i, p in enumerate(PATTERNS)], "x").collect()
    for i, p in enumerate(PATTERNS):
        own = re.compile(p.replace("$", r"\Z"))
        assert [r[i] for r in got] == [bool(own.search(r.x)) for r in got], p


def test_unicode_folding_and_classes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("été",), ("K",), ("٣",)], "x string")
    hits = lambda p, i=False: [r[0] for r in df.select(F.col("x").rlike(rx.parse(p, i).java())).collect()]
    assert hits(r"^\w+$") == [True, True, True]
    assert hits("ÉTÉ", True) == [True, False, False]
    assert hits("k", True) == [False, True, False]
    assert hits(r"\d") == [False, False, True]


def test_templates():
    r = rx.parse(r"(a)(?P<n>b)")
    assert rx.template("$1_x", r) == ["_x"] or rx.template("$1_x", r) == []
    assert rx.template("${1}_x$$", r) == [1, "_x", "$"]
    assert rx.template("$n-$9", r) == [2, "-"]
    assert rx.template(r"\$1", r) == ["\\", 1]
    assert rx.template("$1", r, literal=True) == ["$1"]


def test_plans():
    assert boolplan.build(".*").op == "scan" and boolplan.build("x").op == "scan" and boolplan.build("(").op == "scan"
    assert boolplan.build("foo|x").op == "scan"
    assert boolplan.build("foo|bar").op == "or"
    assert boolplan.build("(foo)*bar") == boolplan.build("bar")
    assert boolplan.build("ab(?:cd)ef") == boolplan.build("abcdef")
    assert boolplan.build("foo", ignore_case=True).op == "scan"
    assert boolplan.build("(?:hello){2}") == boolplan.build("hellohello")


def test_globs():
    m = lambda g, p, s=True: bool(re.match(glob_regex(g, s).replace("\\z", "\\Z"), p))
    assert m("*.py", "/a/b.py") and not m("*.py", "/a/b.pyc")
    assert m("/a/**/c", "/a/c") and m("/a/**/c", "/a/b/c")
    assert m("*.{rs,py}", "x.rs") and m("[!a]b", "cb") and not m("[!a]b", "ab")
    assert not m("*.py", "a/b.py", False)
    with pytest.raises(ValueError):
        glob_regex("[a")


def test_ignore_rules():
    i = Ignore("*.log\n!keep.log\n/build/\nsub/x\n# no\n")
    assert i.verdict("a/b.log", False) is True
    assert i.verdict("keep.log", False) is False
    assert i.verdict("build", True) is True and i.verdict("build", False) is None and i.verdict("a/build", True) is None
    assert i.verdict("sub/x", False) is True and i.verdict("a/sub/x", False) is None
