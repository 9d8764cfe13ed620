"""Secret scan by one combined deterministic automaton.

All rules are parsed, joined and made into one minimal automaton over bytes (subset construction,
then partition refinement), whose transition array is walked once over each byte. Where it accepts, a
small automaton of the reversed rule walks back to the start. A rule that ends in an open run of one set ([0-9a-z]+)
is in the automaton with the least length of that run: the longest match ends where the run ends, which is looked up
once for each run, so a value of megabytes takes one walk back over what is before it. A private key is found by its
header and goes on to its END line (to the end of the base64 run where there is none). Per rule the matches are the leftmost
and longest that count (`least`, `tail`) and don't overlap, with no letter, digit or _ directly before (`left`) or after (`right`).

Defined results: null and empty texts hold no secrets; rows with a null doc_id are reported with a null
id; repeated rows are reported once each; matches of different rules may overlap in find(), and are
merged under the name of the first and longest in redact(). Offsets are characters, from 0.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import automaton as am
from quern.llm.common import pick, slices


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    fold_case: bool = False
    left: bool = True
    right: bool = True
    least: int = 0  # bytes; shorter matches don't count (cheaper than counting states in open-ended runs)
    tail: int = 0  # bytes; so long must the letters, digits and +/_- be that end the match
    head: str = ""  # what the automaton looks for, where the pattern goes on behind it at length (a loop there would multiply its states)


_PEM = r"(?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
#: Behind a key's header: all up to its END line; without one, header lines and the base64 run (line ends may be
#: written \\n, lines may be quoted), whose last line may be short.
_BODY = (
    rf"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END {_PEM}"
    r"|(?:(?:\s*+[A-Za-z][A-Za-z0-9\-]*+: [^\r\n]*+)*+(?:(?:[\s\"',>]|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:[\s\"',>]|\\[nr])*+[A-Za-z0-9+/=]{1,15}+)?+)?+)"
)
#: The production rules.
RULES = (
    Rule("aws_access_key", r"(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}"),
    Rule("github_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("google_api_key", r"AIza[0-9A-Za-z_\-]+", right=False, least=39),
    Rule("slack_token", r"xox[abeprs]-[A-Za-z0-9\-]+", right=False, least=16),
    Rule("stripe_key", r"[rs]k_(?:live|test)_[0-9A-Za-z]+", least=32),
    Rule("private_key", rf"-----BEGIN {_PEM}{_BODY}", left=False, right=False, head=rf"-----BEGIN {_PEM}"),
    Rule("json_web_token", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_.\-]+", right=False, least=40),
    Rule("assigned_secret", r"(?:token|secret|passwd|password|api[_\-]?key|access[_\-]?key|auth[_\-]?key|client[_\-]?secret|private[_\-]?key)[\"' \t!%&*$#]*[=:][\"'> \t!%&*$#]*[A-Za-z0-9+/_\-]+", True, False, False, tail=16),
)


_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_TAIL = _WORD | frozenset(b"+/-")


@dataclass(frozen=True)
class Compiled:
    rules: tuple[Rule, ...]
    forward: am.Dfa
    backward: tuple[am.Dfa, ...]
    runs: tuple[re.Pattern | None, ...]  # the open run that each rule ends in


@lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    if len(rules) > 62:
        raise ValueError("at most 62 rules to an automaton")
    trees, runs = [], []
    for r in rules:
        tree, run = am.closed(am.parse(r.head or r.pattern, r.fold_case))
        if run is not None and r.right and not run <= _WORD:
            raise ValueError(f"{r.name}: a rule with `right` may end in an open run of letters, digits and _ only")
        trees.append(tree)
        runs.append(None if run is None or r.head else re.compile(b"[" + b"".join(b"\\x%02x" % x for x in sorted(run)) + b"]*+"))
    return Compiled(rules, am.compile_dfa(trees, True, [r.left for r in rules]), tuple(am.compile_dfa([am.reverse(t)], False) for t in trees), tuple(runs))


def scan_texts(texts: list[bytes], c: Compiled) -> list[list[tuple[int, int, int]]]:
    """For each text its matches (start, end, rule number) in bytes, by start, end and rule."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    ends = np.cumsum([len(t) + 1 for t in texts])
    at, states = am.scan(c.forward, np.frombuffer(b"\xff".join(texts), np.uint8))
    if not len(at):
        return out
    which = np.searchsorted(ends, at, side="right")
    where = at - np.concatenate([[0], ends[:-1]])[which] + 1
    found: dict[tuple[int, int], dict[int, int]] = {}
    reach: dict[tuple[int, int], int] = {}  # where the last open run that was looked up ends
    for d, end, state in zip(which.tolist(), where.tolist(), states.tolist()):
        text, mask = texts[d], int(c.forward.rules[state])
        whole_end = end
        while mask:
            end = whole_end
            k = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            rule, begun = c.rules[k], end
            if c.runs[k] is not None:
                if end > reach.get((d, k), -1):
                    reach[d, k] = c.runs[k].match(text, end).end()
                end = reach[d, k]
            if rule.right and end < len(text) and text[end] in _WORD:
                continue
            starts = [s for s in am.begins(c.backward[k], text, begun) if not (rule.left and s and text[s - 1] in _WORD)]
            if rule.head:  # the header's last dash is where it accepts: once a header
                whole = re.compile(rule.pattern.encode(), re.I if rule.fold_case else 0)
                end = max((m.end() for s in starts if (m := whole.match(text, s))), default=end)
            if starts:
                spans = found.setdefault((d, k), {})
                for s in starts:
                    spans[s] = max(end, spans.get(s, 0))
    for (d, k), spans in found.items():
        last, rule = -1, c.rules[k]
        for s in sorted(spans):
            end = spans[s]
            if s < last or end - s < max(rule.least, rule.tail) or rule.tail and not _TAIL.issuperset(texts[d][end - rule.tail : end]):
                continue  # a match that doesn't count hides none that begins inside it
            last = end
            out[d].append((s, end, k))
    for x in out:
        x.sort()
    return out


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rule, start, length, digest) of every secret; digest: SHA-256 of it, so that the secret itself isn't spread."""
    c = compile_rules(rules)

    def run(batches):
        for b in slices(batches, "t", 4 << 20):
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            rows = [
                (ids[i], c.rules[k].name, len(t[:s].decode()), len(t[s:e].decode()), hashlib.sha256(t[s:e]).hexdigest())
                for i, (t, spans) in enumerate(zip(texts, scan_texts([t or b"" for t in texts], c)))
                for s, e, k in spans
            ]
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=["doc_id", "rule", "start", "length", "digest"])

    return pick(docs, k="doc_id", t="text").select(F.col("k").try_cast("long").alias("k"), "t").where("t is not null").mapInArrow(run, "doc_id long, rule string, start long, length long, digest string")


def redacted(text: bytes, spans: list[tuple[int, int, int]], c: Compiled) -> bytes:
    parts, last, i = [], 0, 0
    while i < len(spans):
        s, e, k = spans[i]
        best = e
        i += 1
        while i < len(spans) and spans[i][0] < e:
            if spans[i][0] == s and spans[i][1] > best:
                best, k = spans[i][1], spans[i][2]
            e = max(e, spans[i][1])
            i += 1
        parts += [text[last:s], b"[" + c.rules[k].name.encode() + b"]"]
        last = e
    return b"".join(parts) + text[last:]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by [rule]; n_chars follows the text where it was its length. All columns stay.
    Without a column `text` there are no secrets."""
    if "text" not in docs.columns:
        return docs
    c = compile_rules(rules)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            texts = b.column(at).cast(pa.binary()).to_pylist()
            found = scan_texts([t or b"" for t in texts], c)
            if any(found):
                new = [redacted(t, spans, c) if spans else t for t, spans in zip(texts, found)]
                cols = list(b.columns)
                cols[at] = pa.array(new, pa.binary()).cast(b.schema.field(at).type)
                if count is not None:
                    old = cols[count].to_pylist()
                    cols[count] = pa.array(
                        [len(x.decode()) if spans and n == len(t.decode()) else n for x, t, spans, n in zip(new, texts, found, old)], b.schema.field(count).type
                    )
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
