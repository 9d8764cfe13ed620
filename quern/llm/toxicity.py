"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits and signs that stand for letters) and
scanned once by an Aho-Corasick automaton that holds the lexicon and the exception phrases. A hit
counts where its entry begins a word (stems) or is a whole word (words) and lies in no exception
phrase. score = 1000 * (sum of weights) / words (runs without white space). A document is toxic where it has `min_hits`
hits, or fewer that weigh as much as so many plain insults, and a score of `threshold` at least. Signs at a
word's edge or doubled (@sshole, a$$) may be letters or punctuation: such a text is scanned once more with them folded.

The lexicon is a curated list and, with labels, entries learned from a sample of at most
`sample_rows` labelled documents (smoothed log-odds of the token rate in toxic against other texts).

Defined results: a null or empty text has score 0 and is not toxic. A null doc_id is carried as it
is. Every row is judged by its own text, so repeated rows get the same decision. Empty tables give
empty results; with no usable labels the curated list alone is used. Extra columns are ignored by
score() and carried unchanged by keep_clean().
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import pick, slices

#: Curated entries: folded on load. Weights are relative to 1 for a plain insult.
WORDS = {
    "idiot": 1.0, "idiots": 1.0, "moron": 1.0, "morons": 1.0, "stupid": 0.8, "pathetic": 0.8, "worthless": 0.9, "disgusting": 0.8,
    "scum": 1.0, "loser": 0.8, "losers": 0.8, "trash": 0.7, "clown": 0.6, "imbecile": 1.0, "dumbass": 1.2, "bastard": 1.2, "asshole": 1.5,
    "retard": 1.5, "vermin": 1.0, "subhuman": 1.5, "slut": 1.5, "whore": 1.5, "bitch": 1.3, "faggot": 2.0, "kys": 2.0,
}
#: Phrases in which an entry is harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown car", "class clown", "rodeo clown", "sore loser",
    "stupid simple", "pond scum", "useful idiot", "idiot proof", "the idiot by dostoevsky", "worthless check", "vermin control",
)

_SAME = {"a": "@аα", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еεё", "g": "ɡ", "h": "һн", "i": "іιıl1|!ї", "j": "ј", "k": "кκ", "m": "м", "n": "ո", "o": "0оοσ", "p": "рρ", "r": "г", "s": "5$ѕ", "t": "7тτ", "u": "υս", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "2"}
_SAME["e"] += "3"
_SAME["a"] += "4"
_SAME["g"] += "9"
_SAME["b"] += "8"
_WIDE = {ord(c): a for a, cs in _SAME.items() for c in cs if ord(c) > 255}
_WIDE |= {ord(chr(k).upper()): v for k, v in list(_WIDE.items()) if len(chr(k).upper()) == 1}
#: Characters that show nothing (soft hyphen, zero width, direction, joiners, selectors) and accents on their own.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\u0300-\u036f]")
_MARKS = re.compile(rb"(?<=\w)[@$!|](?=\w)")
_EDGES = re.compile(rb"(?<=[\w\x80-\xff])[@$!|]+|[@$!|]+(?=[\w\x80-\xff])")


def _table() -> bytes:
    out = bytearray(range(256))
    for i in range(256):
        c = unicodedata.normalize("NFD", chr(i).lower())[0]
        out[i] = ord(c) if ord(c) < 256 else i
    for a, cs in _SAME.items():
        for c in cs:
            if ord(c) < 256 and c not in "@$!|":
                out[ord(c)] = ord(a)
    out[ord("L")] = out[ord("l")] = ord("i")
    return bytes(out)


_TABLE = _table()
_SIGNS = {b"@": b"a", b"$": b"s", b"!": b"i", b"|": b"i"}


def fold(text: str, edges: bool = False) -> str:
    """Case, accents, look-alikes, digits: one byte table where the text is Latin-1, else a slower path. Characters that
    show nothing are taken out first, so that none can break up a word.
    edges: signs that touch a letter on one side, or another such sign, are letters as well."""
    try:
        b = text.encode("latin-1").replace(b"\xad", b"")
    except UnicodeEncodeError:
        b = unicodedata.normalize("NFC", _HIDDEN.sub("", unicodedata.normalize("NFKD", text))).translate(_WIDE).encode("latin-1", "replace")
    if any(m in b for m in _SIGNS):
        marks = _EDGES if edges else _MARKS
        b = marks.sub(lambda m: b"".join(_SIGNS[m[0][i : i + 1]] for i in range(len(m[0]))), b)
    return b.translate(_TABLE).decode("latin-1")


@dataclass(frozen=True)
class Lexicon:
    """entries: (folded text, weight, whole word?)."""

    entries: tuple[tuple[str, float, bool], ...]
    exceptions: tuple[str, ...]
    threshold: float = 4.0
    min_hits: int = 2

    def enough(self, weights: float, hits: int) -> bool:
        return hits >= self.min_hits or weights >= max(1, self.min_hits)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for text, weight, whole in self.entries:
            a.add_word(text, (len(text), weight, whole))
        for text in self.exceptions:
            a.add_word(text, (len(text), 0.0, None))
        if len(a):
            a.make_automaton()
        return a


def base_lexicon(**kw) -> Lexicon:
    return Lexicon(tuple((fold(w), x, True) for w, x in sorted(WORDS.items())), tuple(map(fold, EXCEPTIONS)), **kw)


def measure(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
    """(sum of weights, hits, words) of one text."""
    if not text:
        return 0.0, 0, 0
    words = len(text.split())
    if not len(automaton):
        return 0.0, 0, words
    folds = [fold(text)]
    if any(m in text for m in "@$!|＠＄！｜") and (other := fold(text, True)) != folds[0]:
        folds.append(other)
    found, free, n = [], [], len(folds[0])
    for folded in folds:
        for end, (size, weight, whole) in automaton.iter(folded):
            begin = end - size + 1
            if begin and folded[begin - 1].isalpha():
                continue
            if whole is not False and end + 1 < n and folded[end + 1].isalpha():
                continue
            (free if whole is None else found).append((begin, end, weight))
    if free:
        found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b, _ in free)]
    best: dict[int, float] = {}  # entries that begin at the same place count once, by the highest weight
    for begin, _, weight in found:
        best[begin] = max(weight, best.get(begin, 0.0))
    return sum(best.values()), len(best), words


def _families(texts: list[str]) -> list[int]:
    """One number per family of near copies, so that copies don't vote again."""
    seen: dict[tuple[int, int], int] = {}
    out = []
    for i, t in enumerate(texts):
        w = fold(t).split()
        grams = {" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))}
        x = np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64, len(grams))
        keys = [(k, int((x * np.uint64(k)).min())) for k in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        root = next((seen[k] for k in keys if k in seen), i)
        for k in keys:
            seen.setdefault(k, root)
        out.append(root)
    return out


_TOKEN = re.compile(r"[^\W\d_]+")


def learn(texts: list[str], toxic: list[int], *, least: int = 6, odds: float = 12.0, precision: float = 0.35) -> Lexicon:
    """Adds stems and words whose rate in toxic texts is `odds` times the rate elsewhere, seen in `least`
    families of toxic texts, of which `precision` of all families with it are; then sets the threshold where it separates the sample best."""
    base = base_lexicon()
    families = _families(texts)
    first = {f: i for i, f in reversed(list(enumerate(families)))}
    use = [(texts[i], toxic[i]) for i in sorted(first.values())]
    counts, docs = (Counter(), Counter()), (Counter(), Counter())
    total = [1, 1]
    for text, y in use:
        tokens = [t for t in _TOKEN.findall(fold(text)) if len(t) > 3]
        own = Counter(tokens)
        total[y] += len(tokens)
        for t, n in list(own.items()):
            for k in range(4, min(len(t), 9)):
                own["^" + t[:k]] += n
        counts[y].update(own)
        docs[y].update(own.keys())
    ranked = []
    least = max(least, sum(y for _, y in use) // 50)
    for f, d in docs[1].items():
        if d < least:
            continue
        a, b = counts[1][f], counts[0][f]
        # cautious rates: two standard errors below in toxic texts, two above in the others
        lift = (max(0.0, a - 2 * math.sqrt(a)) / total[1]) / ((b + 2 * math.sqrt(b) + 1) / total[0])
        if lift >= odds and d >= precision * (d + docs[0][f]):
            e = (a + b) * total[1] / (total[0] + total[1])
            ranked.append((a * math.log(a / e) + (b * math.log(b / (a + b - e)) if b else 0), f, math.log(lift)))
    entries = {w: (w, x, True) for w, x, _ in base.entries}
    chosen: list[str] = []
    for _, f, weight in sorted(ranked, key=lambda r: (-r[0], r[1])):
        stem, whole = f.lstrip("^"), f[0] != "^"
        if any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            continue
        chosen.append(stem)
        entries[stem] = (stem, round(min(2.0, weight / 3), 4), whole)
    lexicon = Lexicon(tuple(sorted(entries.values())), base.exceptions, base.threshold, base.min_hits)
    automaton = lexicon.automaton()
    scored = sorted(((1000 * s / max(1, w) if base.enough(s, n) else 0.0, y) for (t, y) in use for s, n, w in [measure(t, automaton)]), reverse=True)
    positives, hit, best, at = sum(y for _, y in scored), 0, 0.0, base.threshold
    for i, (s, y) in enumerate(scored):
        hit += y
        if s <= 0:
            break
        f1 = 2 * hit / (i + 1 + positives)
        if f1 > best and (i + 1 == len(scored) or scored[i + 1][0] < s):
            best, at = f1, (s + max(1.0, scored[i + 1][0] if i + 1 < len(scored) else 0.0)) / 2
    return Lexicon(lexicon.entries, lexicon.exceptions, min(base.threshold * 2, max(1.0, at)) if positives else base.threshold, base.min_hits)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = 4096) -> Lexicon:
    """Learns from the `sample_rows` labelled documents whose ids hash lowest (a documented bound: the
    sample is all that reaches the driver; scoring covers every row)."""
    ids = (
        pick(labels, k="doc_id", y="toxic").where("k is not null and y is not null").select("k", F.col("y").cast("int").alias("y"))
        .groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    )
    rows = pick(docs, k="doc_id", t="text").join(F.broadcast(ids), "k").where("t is not null").select("k", "t", "y").collect()
    rows = sorted({r.k: r for r in rows}.values(), key=lambda r: r.k)[:sample_rows]
    return learn([r.t for r in rows], [min(1, max(0, r.y)) for r in rows])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, toxic, score, hits, words) for every row."""

    def run(batches):
        automaton = lexicon.automaton()
        for b in slices(batches, "t"):
            got = [measure(t, automaton) for t in b.column(1).to_pylist()]
            scores = [1000.0 * s / w if w else 0.0 for s, _, w in got]
            flags = [lexicon.enough(s, n) and x >= lexicon.threshold for (s, n, _), x in zip(got, scores)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(flags, pa.bool_()), pa.array(scores, pa.float64()), pa.array([n for _, n, _ in got], pa.int64()), pa.array([w for _, _, w in got], pa.int64())],
                names=["doc_id", "toxic", "score", "hits", "words"],
            )

    return pick(docs, k="doc_id", t="text").select(F.col("k").try_cast("long").alias("k"), "t").mapInArrow(run, "doc_id long, toxic boolean, score double, hits long, words long")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs without the toxic rows; all columns stay as they are. Without a column `text` nothing is toxic."""
    if "text" not in docs.columns:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        automaton = lexicon.automaton()
        for b in slices(batches, "text"):
            mask = []
            for t in b.column(at).to_pylist():
                s, n, w = measure(t, automaton)
                mask.append(not (lexicon.enough(s, n) and 1000.0 * s / max(1, w) >= lexicon.threshold))
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
