"""What n-grams a text must have for a pattern to match in it: a boolean plan, made from the pattern's tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import ngram
from quern.functions.regex import Node, Regex, RegexError, parse


@dataclass(frozen=True)
class Plan:
    """op: lookup (key), and / or (parts), scan (every document)."""

    op: str
    key: int = 0
    parts: tuple = ()
    gram: bytes = b""

    def keys(self) -> list[int]:
        return [self.key] if self.op == "lookup" else sorted({k for p in self.parts for k in p.keys()})

    def column(self, has) -> Column:
        """The plan over columns; has(key) tells whether a document has the n-gram."""
        if self.op == "lookup":
            return has(self.key)
        if self.op == "scan":
            return F.lit(True)
        out = self.parts[0].column(has)
        for p in self.parts[1:]:
            out = out & p.column(has) if self.op == "and" else out | p.column(has)
        return out

    def without(self, common: frozenset) -> "Plan":
        """The plan where n-grams of these keys tell nothing."""
        if self.op == "lookup":
            return SCAN if self.key in common else self
        return self if self.op == "scan" else _join(self.op, [p.without(common) for p in self.parts])

    def text(self) -> str:
        if self.op == "lookup":
            return self.gram.decode("utf-8", "replace")
        return "*" if self.op == "scan" else "(" + f" {self.op} ".join(p.text() for p in self.parts) + ")"


SCAN = Plan("scan")


def _literal(data: bytes) -> Plan:
    if len(data) < 2:
        return SCAN
    return _join("and", [Plan("lookup", ngram.key(g), gram=g) for g in dict.fromkeys(ngram.cover(data))])


def _join(op: str, parts: list[Plan]) -> Plan:
    if op == "and":
        parts = [p for p in parts if p.op != "scan"]
    elif any(p.op == "scan" for p in parts):
        return SCAN
    flat: list[Plan] = []
    for p in parts:
        flat += p.parts if p.op == op else (p,)
    flat = list(dict.fromkeys(flat))
    return SCAN if not flat else flat[0] if len(flat) == 1 else Plan(op, parts=tuple(flat))


def _single(n: Node) -> str | None:
    """The text that the node always matches, or None."""
    if n.kind == "lit":
        return None if n.flags.i and n.text.upper() != n.text.lower() else n.text
    if n.kind == "cat":
        got = [_single(p) for p in n.parts]
        return None if None in got else "".join(got)
    if n.kind == "rep" and n.least == n.most and n.least <= 64 and (s := _single(n.parts[0])) is not None:
        return s * n.least
    return _single(n.parts[0]) if n.kind in ("cap", "grp") else None


def _plan(n: Node) -> Plan:
    if (s := _single(n)) is not None:
        return _literal(s.encode())
    if n.kind == "cat":
        parts, run = [], ""
        for p in n.parts:
            if (s := _single(p)) is not None:
                run += s
                continue
            parts, run = [*parts, _literal(run.encode()), _plan(p)], ""
        return _join("and", [*parts, _literal(run.encode())])
    if n.kind == "alt":
        return _join("or", [_plan(p) for p in n.parts])
    if n.kind == "rep":
        return _plan(n.parts[0]) if n.least else SCAN
    return _plan(n.parts[0]) if n.kind in ("cap", "grp") else SCAN


def build(pattern: str | Regex, ignore_case: bool = False) -> Plan:
    """Patterns that can't be read scan everything."""
    try:
        return _plan((parse(pattern, ignore_case) if isinstance(pattern, str) else pattern).tree)
    except RegexError:
        return SCAN
