"""Chat formatting: roles of a plain transcript by a hidden Markov model, then one canonical rendering.

The states are (role, first line of a turn or a later one). What a line shows: a speaker marker of a
role or of somebody else, how long it is, whether it asks, its shape (blank, list, code, heading), and
whether the line before was blank. Emissions of the features multiply; Viterbi finds the best path in
log space; each "first" state opens a turn.

fit() counts transitions and emissions on at most `sample` conversations whose roles are known (those
whose ids hash lowest, a documented bound), written down in several marker styles, some of them with
lost markers; parse() and the query cover all rows. Without usable conversations the smoothed
prior alone decides.

Defined results: rows without a conv_id belong to no conversation and are left out. Turns are ordered by
(turn, role, text), nulls first; equal rows count once. A null text is an empty turn; a null or unknown
role leaves the line without a marker, for the model to decide. An empty or null transcript has no
turns. Control marks inside texts are broken by a backslash. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import pick, slices

ROLES = ("system", "user", "assistant")
_NAMES = {
    "user": "user human q question customer client prompt me you visitor person patient student asker",
    "assistant": "assistant ai bot a answer agent model chatbot gpt response reply helper support doctor tutor",
    "system": "system sys instruction instructions context setup developer",
}
_ROLE_OF = {n: ROLES.index(r) for r, ns in _NAMES.items() for n in ns.split()}
_MARK = re.compile(r"\s*(?:(?:\*\*|__|#{1,4}\s*|>\s*|[-*]\s+)?[\[(<|]{0,2}\s*([A-Za-z][\w .'-]{0,30}?)\s*[\])>|]{0,2}(?:\s*\(?\d{1,2}:\d\d(?::\d\d)?\)?)?\s*(?:\*\*|__)?\s*(?:[:>»]|\]|\|>)(?:\*\*|__)?\s*|#{2,4}\s*([A-Za-z]+)\s*$)")
_NO_MARK, _OTHER = 3, 4
#: values of each feature: marker, length, asks, shape, blank line before
_SIZES = (5, 6, 2, 6, 2)
STATES = 2 * len(ROLES)


def marker(line: str) -> tuple[int, int]:
    """(kind of speaker marker: a role, 3 none, 4 another name; where the words after it begin)."""
    m = _MARK.match(line)
    if not m:
        return _NO_MARK, 0
    name = (m[1] or m[2]).strip(" .'-_").lower()
    role = _ROLE_OF.get(name, _ROLE_OF.get(re.sub(r"[\s_]*\d+$", "", name)))
    if role is not None:
        return role, m.end()
    return (_OTHER, m.end()) if (m[1] or m[2])[0].isupper() and name.count(" ") < 3 else (_NO_MARK, 0)


def features(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), len(_SIZES)), np.int64)
    blank = True
    for i, line in enumerate(lines):
        kind, _ = marker(line)
        s = line.strip()
        n = len(s)
        shape = 0 if not s else 1 if s.startswith("```") else 2 if s[0] in "-*•" else 3 if s[0].isdigit() else 4 if s[0] in "#>|" else 5
        out[i] = kind, 0 if not n else 1 + (n > 30) + (n > 100) + (n > 250) + (n > 600), s.endswith("?"), shape, blank
        blank = not s
    return out


class Model:
    """Log probabilities of starts, transitions and emissions."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        self.start, self.move, self.emit = log(start), log(move), [log(e) for e in emit]

    def path(self, lines: list[str]) -> np.ndarray:
        """The likeliest states (role * 2, + 1 for later lines)."""
        n = len(lines)
        if not n:
            return np.zeros(0, np.int64)
        x = features(lines)
        score = sum(e[:, x[:, k]].T for k, e in enumerate(self.emit))
        back = np.zeros((n, STATES), np.int64)
        best = self.start + score[0]
        for i in range(1, n):
            all_ = best[:, None] + self.move
            back[i] = all_.argmax(axis=0)
            best = all_.max(axis=0) + score[i]
        out = np.zeros(n, np.int64)
        out[-1] = best.argmax()
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What the counts begin with: markers tell roles, speakers take turns, later lines keep the role."""
    start = np.array([2, 0.01, 4, 0.01, 1, 0.01])
    move = np.full((STATES, STATES), 1e-4)
    for r in range(3):
        for s in (2 * r, 2 * r + 1):
            move[s, 2 * r + 1] = 4
            for t in range(3):
                move[s, 2 * t] = 0.02 if t == r or t == 0 else 1
    marks = np.full((STATES, 5), 0.01)
    for r in range(3):
        marks[2 * r, r], marks[2 * r, _NO_MARK], marks[2 * r, _OTHER] = 8, 0.5, 0.5
        marks[2 * r + 1, _NO_MARK], marks[2 * r + 1, _OTHER] = 8, 0.2
    return start, move, [marks] + [np.ones((STATES, k)) for k in _SIZES[1:]]


_STYLES = ("{Role}: {text}", "### {Role}:\n{text}", "[{role}] {text}", "**{Role}:** {text}", "<|{role}|>{text}", "{alias}: {text}", "{text}")
_ALIAS = {"user": ("Human", "Q", "Customer"), "assistant": ("AI", "A", "Bot"), "system": ("System", "Context", "Instructions")}


def written(turns: list[tuple[str, str]], style: int, lost: float = 0.0, seed: int = 0) -> tuple[list[str], list[int]]:
    """A transcript's lines and true states, in one marker style; `lost`: the share of markers left out."""
    rng = np.random.default_rng(seed)
    lines, states = [], []
    for role, text in turns:
        form = _STYLES[-1] if rng.random() < lost else _STYLES[style % (len(_STYLES) - 1)]
        made = form.format(Role=role.capitalize(), role=role, alias=_ALIAS[role][style % 3], text=text).split("\n")
        lines += made
        r = ROLES.index(role)
        states += [2 * r] + [2 * r + 1] * (len(made) - 1)
    return lines, states


def train(samples: list[list[tuple[str, str]]], lost: float = 0.1) -> Model:
    """Counts over conversations of (role, text) turns, each in two styles."""
    start, move, emit = prior()
    for turns in samples:
        turns = [(r, t or "") for r, t in turns if r in ROLES]
        if not turns:
            continue
        seed = zlib.crc32("".join(t for _, t in turns).encode())
        for k in (0, 1):
            lines, states = written(turns, (seed + k) % 97, lost, seed + k)
            x = features(lines)
            start[states[0]] += 1
            np.add.at(move, (states[:-1], states[1:]), 1)
            for f, e in enumerate(emit):
                np.add.at(e, (states, x[:, f]), 1)
    return Model(start, move, emit)


def parse(text: str | None, model: Model) -> list[tuple[str, str]]:
    """(role, text) of each turn of a transcript; speaker markers are taken off the first lines."""
    if not text or not text.strip():
        return []
    lines = text.replace("\r\n", "\n").split("\n")
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, model.path(lines).tolist()):
        role = ROLES[state // 2]
        if state % 2 == 0 or not turns:
            turns.append((role, [line[marker(line)[1] :]]))
        else:
            turns[-1][1].append(line)
    return [(r, "\n".join(ls).strip("\n")) for r, ls in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical turns: <|im_start|>role, the text, <|im_end|>."""
    return "".join(f"<|im_start|>{r}\n{t.replace('<|im_', '<' + chr(92) + '|im_')}<|im_end|>\n" for r, t in turns)


def _gathered(conversations: DataFrame) -> DataFrame:
    base = pick(conversations, c="conv_id", n="turn", r="role", t="text").select(F.expr("try_cast(c as bigint)").alias("c"), F.expr("try_cast(n as bigint)").alias("n"), "r", F.coalesce("t", F.lit("")).alias("t"))
    return base.where("c is not null").groupBy("c").agg(F.sort_array(F.collect_set(F.struct("n", "r", "t"))).alias("turns"))


def transcripts(conversations: DataFrame, mixed: bool = False, lost: int = 10) -> DataFrame:
    """(conv_id, text): each conversation as a plain transcript, a turn's role before its text. mixed: each in one of the
    marker styles, by a hash of its id, and of `lost` in a hundred turns, by a hash of id and turn, the marker is left out."""
    name = lambda x: F.trim(x["r"])
    one = lambda x: F.concat(F.when(name(x) != "", F.concat(F.initcap(name(x)), F.lit(": "))).otherwise(""), x["t"])
    rows = _gathered(conversations)
    if not mixed:
        return rows.select(F.col("c").alias("conv_id"), F.array_join(F.transform("turns", one), "\n").alias("text"))
    style = F.pmod(F.xxhash64("c", F.lit(1)), F.lit(5))

    def marked(x):
        r = name(x)
        alias = F.when(F.lower(r) == "user", "Human").when(F.lower(r) == "assistant", "AI").otherwise(F.initcap(r))
        mark = (
            F.when(style == 0, F.concat(F.initcap(r), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.initcap(r), F.lit(":\n")))
            .when(style == 2, F.concat(F.lit("["), F.lower(r), F.lit("] "))).when(style == 3, F.concat(F.lit("**"), F.initcap(r), F.lit(":** "))).otherwise(F.concat(alias, F.lit(": ")))
        )
        shown = (F.coalesce(r, F.lit("")) != "") & (F.pmod(F.xxhash64("c", x["n"], x["t"]), F.lit(100)) >= lost)
        return F.concat(F.when(shown, mark).otherwise(""), x["t"])

    return rows.select(F.col("c").alias("conv_id"), F.array_join(F.transform("turns", marked), "\n").alias("text"))


def fit(spark: SparkSession, conversations: DataFrame, sample: int = 2000) -> Model:
    """Trains on the `sample` conversations whose ids hash lowest."""
    ids = pick(conversations, c="conv_id").select(F.col("c").try_cast("long").alias("c")).where("c is not null").distinct().orderBy(F.xxhash64("c"), "c").limit(sample)
    c = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = _gathered(c.join(ids, F.col("conv_id").try_cast("long") == ids["c"], "left_semi")).orderBy("c").collect()
    return train([[(x.r, x.t) for x in r.turns] for r in rows])


def formatted(texts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turns, roles, chat) of transcripts (conv_id, text): how many turns, their roles, the rendering."""

    def run(batches):
        for b in slices(batches, "t"):
            got = [parse(t, model) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array([[r for r, _ in g] for g in got], pa.list_(pa.string())), pa.array([render(g) for g in got], pa.string())],
                names=["conv_id", "turns", "roles", "chat"],
            )

    return pick(texts, k="conv_id", t="text").select(F.col("k").try_cast("long").alias("k"), "t").mapInArrow(run, "conv_id long, turns long, roles array<string>, chat string")
