"""A regular-expression front end: one syntax, parsed here, written out for the JVM and for RE2.

The syntax is that of linear-time engines: Unicode classes, no look-around, no back-references. What
the two targets would read differently is spelled out or refused, never passed through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_PERL = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Pc}", "s": r"\t\n\x0B\f\r \x{85}\p{Z}"}
_ESC = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}
_META = set("\\.+*?()|[]{}^$#&-~/ \"'<>%,:;=@!`_")


class RegexError(ValueError):
    """The pattern can't be read, or would mean different things to different engines."""


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    swap: bool = False


@dataclass(frozen=True)
class Node:
    kind: str  # lit, set, dot, look, cat, alt, rep, cap, grp
    text: str = ""
    parts: tuple = ()
    least: int = 0
    most: int | None = None
    lazy: bool = False
    flags: Flags = Flags()


class _Reader:
    def __init__(self, p: str, flags: Flags):
        self.p, self.i, self.flags, self.names, self.count = p, 0, flags, [], 0

    def at(self, s: str) -> bool:
        return self.p.startswith(s, self.i)

    def take(self, s: str) -> bool:
        if self.at(s):
            self.i += len(s)
            return True
        return False

    def fail(self, why: str):
        raise RegexError(f"{why} at {self.i} in {self.p!r}")

    def alternatives(self) -> Node:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Node("alt", parts=tuple(parts))

    def sequence(self) -> Node:
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            atom = self.atom()
            if atom is not None:
                parts.append(self.repeated(atom))
        return parts[0] if len(parts) == 1 else Node("cat", parts=tuple(parts))

    def repeated(self, node: Node) -> Node:
        while self.i < len(self.p):
            if self.take("*"):
                least, most = 0, None
            elif self.take("+"):
                least, most = 1, None
            elif self.take("?"):
                least, most = 0, 1
            elif self.at("{"):
                m = re.compile(r"\{(\d+)(,(\d*))?\}").match(self.p, self.i)
                if not m:
                    self.fail("bad repetition")
                least = int(m[1])
                most = least if not m[2] else int(m[3]) if m[3] else None
                if most is not None and most < least or max(least, most or 0) > 1000:
                    self.fail("bad repetition bounds")
                self.i = m.end()
            else:
                break
            if node.kind == "look":
                node = Node("grp", parts=(node,))
            lazy = self.take("?")
            if self.at("+"):
                self.fail("possessive repetition is not part of the syntax")
            node = Node("rep", parts=(node,), least=least, most=most, lazy=lazy != self.flags.swap)
        return node

    def atom(self) -> Node | None:
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            return self.group()
        if c == "[":
            return Node("set", self.klass(), flags=self.flags)
        if c == ".":
            return Node("dot", flags=self.flags)
        if c in "^$":
            return Node("look", c, flags=self.flags)
        if c == "\\":
            return self.escape()
        if c in "*+?":
            self.fail("nothing to repeat")
        if c == "{":
            self.fail("unescaped {")
        return Node("lit", c, flags=self.flags)

    def group(self) -> Node | None:
        outer = self.flags
        if self.take("?"):
            if self.at("=") or self.at("!") or self.at("<=") or self.at("<!") or self.at(">"):
                self.fail("look-around and atomic groups are not part of the syntax")
            m = re.compile(r"P?<([A-Za-z_]\w*)>").match(self.p, self.i)
            if m:
                if m[1] in self.names:
                    self.fail("a group's name is used twice")
                self.i = m.end()
                return self.closed("cap", m[1], outer)
            m = re.compile(r"([imsU]*)(?:-([imsU]+))?([:)])").match(self.p, self.i)
            if not m:
                self.fail("unsupported group")
            self.i = m.end()
            f = outer
            for letters, on in ((m[1], True), (m[2] or "", False)):
                for x in letters:
                    f = replace(f, **{"swap" if x == "U" else x: on})
            self.flags = f
            return self.closed("grp", "", outer) if m[3] == ":" else None
        return self.closed("cap", "", outer)

    def closed(self, kind: str, name: str, outer: Flags) -> Node:
        if kind == "cap":
            self.count += 1
            self.names.append(name)
        inner = self.alternatives()
        if not self.take(")"):
            self.fail("unclosed group")
        self.flags = outer
        return Node(kind, name, (inner,))

    def escape(self) -> Node:
        if self.i >= len(self.p):
            self.fail("trailing backslash")
        c = self.p[self.i]
        self.i += 1
        if c in "dwsDWS":
            return Node("set", f"[{'^' if c.isupper() else ''}{_PERL[c.lower()]}]", flags=self.flags)
        if c in "bBAz":
            return Node("look", "\\" + c, flags=self.flags)
        if c in "pP":
            return Node("set", f"[{self.property(c)}]", flags=self.flags)
        return Node("lit", self.char(c), flags=self.flags)

    def property(self, c: str) -> str:
        m = re.compile(r"\{\^?([A-Za-z]+)\}|([A-Z])").match(self.p, self.i)
        if not m or (name := m[1] or m[2]) not in _CATEGORIES:
            self.fail("unknown property")
        self.i = m.end()
        return f"\\{'P' if (c == 'P') != ('^' in m[0]) else 'p'}{{{_CATEGORIES[name]}}}"

    def char(self, c: str) -> str:
        if c in _ESC:
            return _ESC[c]
        if c == "x":
            m = re.compile(r"\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2})").match(self.p, self.i)
            if not m:
                self.fail("bad \\x")
            self.i = m.end()
            return chr(int(m[1] or m[2], 16))
        if c in _META:
            return c
        self.fail(f"unsupported escape \\{c}")
        return ""

    def klass(self) -> str:
        out, first = ["^"] if self.take("^") else [], True
        while True:
            if self.i >= len(self.p):
                self.fail("unclosed class")
            if self.at("]") and not first:
                self.i += 1
                return "[" + "".join(out) + "]"
            first = False
            if self.at("[:"):
                m = re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i)
                if not m or m[1] or m[2] not in _POSIX:
                    self.fail("unknown POSIX class")
                self.i = m.end()
                out.append(_POSIX[m[2]])
                continue
            if self.at("[") or self.at("&&") or self.at("--") or self.at("~~"):
                self.fail("set operations in classes are not supported")
            low = self.member()
            if len(low) > 1:
                out.append(low)
                continue
            if self.at("-") and not self.at("-]"):
                self.i += 1
                high = self.member()
                if len(high) > 1 or high < low:
                    self.fail("bad range")
                out.append(_quoted(low) + "-" + _quoted(high))
            else:
                out.append(_quoted(low))

    def member(self) -> str:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return c
        e = self.p[self.i] if self.i < len(self.p) else self.fail("trailing backslash")
        self.i += 1
        if e in "dws":
            return _PERL[e]
        if e in "DWS":
            self.fail("a negated class inside a class is not supported")
        return self.property(e) if e in "pP" else self.char(e)


_CATEGORIES = {k: k for k in "L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po S Sm Sc Sk So Z Zs Zl Zp C Cc Cf".split()}
_CATEGORIES |= {"Letter": "L", "Alphabetic": "L", "Uppercase": "Lu", "Lowercase": "Ll", "Number": "N", "Punctuation": "P", "Symbol": "S", "Separator": "Z", "Mark": "M"}


def _quoted(c: str) -> str:
    if c in "\\^$.|?*+()[]{}-&~#/":
        return "\\" + c
    return c if " " <= c <= "~" or ord(c) > 0x9F else f"\\x{{{ord(c):X}}}"


def quote(text: str) -> str:
    """A pattern for the text itself."""
    return "".join("\\" + c if c in "\\.+*?()|[]{}^$" else c for c in text)


@dataclass(frozen=True)
class Regex:
    source: str
    tree: Node
    names: tuple[str, ...]

    def _write(self, n: Node, java: bool) -> str:
        def sub(x: Node) -> str:
            return self._write(x, java)

        def folded(s: str, f: Flags) -> str:
            return f"(?{'iu' if java else 'i'}:{s})" if f.i and not self.all_folded else s

        if n.kind == "lit":
            return folded(_quoted(n.text), n.flags) if n.text.upper() != n.text.lower() else _quoted(n.text)
        if n.kind == "set":
            return folded(n.text, n.flags)
        if n.kind == "dot":
            return r"[\x{0}-\x{10FFFF}]" if n.flags.s else "[^\\n]"
        if n.kind == "look":
            if n.text in "^$":
                return f"(?m:{n.text})" if n.flags.m else (r"\A" if n.text == "^" else r"\z")
            return n.text
        if n.kind == "cat":
            return "".join(f"(?:{sub(x)})" if x.kind == "alt" else sub(x) for x in n.parts)
        if n.kind == "alt":
            return "|".join(map(sub, n.parts))
        if n.kind == "cap":
            if not n.text:
                return f"({sub(n.parts[0])})"
            return f"(?<{_jvm_name(n.text)}>{sub(n.parts[0])})" if java else f"(?P<{n.text}>{sub(n.parts[0])})"
        if n.kind == "grp":
            return f"(?:{sub(n.parts[0])})"
        inner = n.parts[0]
        body = sub(inner) if inner.kind in ("lit", "set", "dot", "cap", "grp") and not (inner.kind in ("lit", "set") and inner.flags.i and not self.all_folded) else f"(?:{sub(inner)})"
        if len(inner.text) == 1 and inner.kind == "lit":
            body = sub(inner)
        times = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((n.least, n.most)) or (f"{{{n.least}}}" if n.most == n.least else f"{{{n.least},{'' if n.most is None else n.most}}}")
        return body + times + ("?" if n.lazy else "")

    @property
    def leaves(self) -> list[Node]:
        out, todo = [], [self.tree]
        while todo:
            n = todo.pop()
            todo += n.parts
            if n.kind in ("lit", "set"):
                out.append(n)
        return out

    @property
    def all_folded(self) -> bool:
        got = self.leaves
        return bool(got) and all(n.flags.i for n in got)

    def java(self) -> str:
        """For rlike, regexp_extract and regexp_replace."""
        prefix = "(?d" + ("U" if self.has_look("\\b", "\\B") else "") + ("iu" if self.all_folded else "") + ")"
        return prefix + self._write(self.tree, True)

    def re2(self) -> str:
        """For an engine that reads RE2 syntax."""
        return ("(?i)" if self.all_folded else "") + self._write(self.tree, False)

    def has_look(self, *kinds: str) -> bool:
        todo = [self.tree]
        while todo:
            n = todo.pop()
            todo += n.parts
            if n.kind == "look" and n.text in kinds:
                return True
        return False

    @property
    def nullable(self) -> bool:
        """Whether it can match nothing at all."""

        def can(n: Node) -> bool:
            if n.kind in ("lit", "set", "dot"):
                return False
            if n.kind == "look":
                return True
            if n.kind == "alt":
                return any(map(can, n.parts))
            if n.kind == "rep":
                return n.least == 0 or can(n.parts[0])
            return all(map(can, n.parts))

        return can(self.tree)

    @property
    def by_lines(self) -> "Regex":
        """The same with ^ and $ at the lines of a text."""
        return Regex(self.source, _multi(self.tree), self.names)


def _multi(n: Node) -> Node:
    return replace(n, parts=tuple(map(_multi, n.parts)), flags=replace(n.flags, m=True) if n.kind == "look" else n.flags)


def _jvm_name(name: str) -> str:
    """JVM group names have letters and digits only."""
    return "g" + "".join(c if c.isalnum() and c.isascii() else f"x{ord(c):x}x" for c in name)


def parse(pattern: str, ignore_case: bool = False) -> Regex:
    r = _Reader(pattern, Flags(i=ignore_case))
    tree = r.alternatives()
    if r.i < len(pattern):
        r.fail("unopened )")
    return Regex(pattern, tree, tuple(r.names))


_REF = re.compile(r"\$(?:\$|\{([^{}]*)\}|([0-9A-Za-z_]+))")


def template(text: str, regex: Regex, literal: bool = False) -> list[str | int]:
    """A replacement's parts: texts and group numbers. $$ is a dollar, the longest name after $ counts, an
    unknown group is nothing. literal: nothing is special."""
    if literal:
        return [text]
    out: list[str | int] = []
    last = 0
    for m in _REF.finditer(text):
        out.append(text[last : m.start()])
        last = m.end()
        if m[0] == "$$":
            out.append("$")
            continue
        name = m[1] if m[1] is not None else m[2]
        if name.isdigit():
            out += [int(name)] if int(name) <= len(regex.names) else []
        elif name in regex.names:
            out.append(regex.names.index(name) + 1)
    return [x for x in [*out, text[last:]] if x != ""]


def java_template(parts: list[str | int], regex: Regex) -> str:
    out = []
    for k, x in enumerate(parts):
        if isinstance(x, str):
            out.append(re.sub(r"([\\$])", r"\\\1", x))
        elif x and regex.names[x - 1]:
            out.append(f"${{{_jvm_name(regex.names[x - 1])}}}")
        else:
            after = parts[k + 1] if k + 1 < len(parts) else ""
            if isinstance(after, str) and after[:1].isdigit():
                parts[k + 1], _ = "", out.append(f"${x}\\{after[0]}" + re.sub(r"([\\$])", r"\\\1", after[1:]))
                continue
            out.append(f"${x}")
    return "".join(out)


def re2_template(parts: list[str | int]) -> str:
    return "".join(f"\\{x}" if isinstance(x, int) else x.replace("\\", "\\\\") for x in parts)


def combine(patterns: list[str], fixed: bool = False) -> str:
    """Several patterns as one; with fixed each is taken as text."""
    own = [quote(p) if fixed else p for p in patterns]
    return own[0] if len(own) == 1 else "|".join(f"(?:{p})" for p in own)


def kind(pattern: str) -> str:
    """all: every line matches; char: one letter, digit or sign that stands for itself; else normal."""
    if pattern in ("", ".*", ".+", "^.*$", "^.+$"):
        return "all" if "+" not in pattern else "filled"
    return "char" if len(pattern) == 1 and "!" <= pattern <= "~" and pattern not in "\\.+*?()|[]{}^$" else "normal"
